"""Features of product names, computed once for each distinct name, and the parts of a similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_key
from .words import CATEGORIES, CONFLICTS, GENERIC, KEPT_IN_LEGACY, NOT_IN_LEGACY, STATES, TRANSLATIONS


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def singular(token: Column, legacy: bool = False) -> Column:
    n = F.length(token)
    one = F.when((n > 4) & token.endswith("s"), F.substring(token, F.lit(1), n - 1)).otherwise(token)
    return one if legacy else F.when((n > 5) & token.endswith("es"), F.substring(token, F.lit(1), n - 2)).otherwise(one)


def all_tokens(name: Column, legacy: bool = False) -> Column:
    """Translated, singular tokens of a name, those without meaning included."""
    words = {k: v for k, v in TRANSLATIONS.items() if not (legacy and k in NOT_IN_LEGACY)}
    raw = F.filter(F.split(normalize_key(name), " "), lambda x: x != "")
    return F.transform(raw, lambda x: singular(F.coalesce(F.try_element_at(literal_map(words), x), x), legacy))


def with_features(names: DataFrame, name: str = "product_name", legacy: bool = False) -> DataFrame:
    """Adds canonical_text, tokens, strong, numbers, categories and states (arrays of distinct values)."""
    generic = [w for w in GENERIC if not (legacy and w in KEPT_IN_LEGACY)]
    by_token = {t: c for c, tokens in CATEGORIES.items() for t in tokens}
    df = names.withColumn("_all", all_tokens(F.col(name), legacy))
    df = df.withColumn("_kept", F.filter("_all", lambda x: ~x.isin(generic)))
    df = df.withColumn("canonical_text", F.array_join("_kept", " ")).withColumn("tokens", F.array_distinct("_kept"))
    df = df.withColumn("strong", F.filter("tokens", lambda x: (F.length(x) >= 4) & ~x.rlike("[0-9]")))
    df = df.withColumn("numbers", F.filter("tokens", lambda x: x.rlike("[0-9]")))
    df = df.withColumn("categories", F.array_distinct(F.filter(F.transform("tokens", lambda x: F.try_element_at(literal_map(by_token), x)), lambda x: x.isNotNull())))
    df = df.withColumn("states", F.array_distinct(F.filter(F.transform("_all", lambda x: F.try_element_at(literal_map(STATES), x)), lambda x: x.isNotNull())))
    return df.drop("_all", "_kept")


FEATURES = ["canonical_text", "tokens", "strong", "numbers", "categories", "states"]


def state_conflict(a: Column, b: Column) -> Column:
    found = F.lit(False)
    for x, y in CONFLICTS:
        found = found | (F.array_contains(a, x) & F.array_contains(b, y)) | (F.array_contains(a, y) & F.array_contains(b, x))
    return found


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(shared(a, b) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(shared(a, b) / least)


def strong_overlap(a: Column, b: Column) -> Column:
    return shared(a, b) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
