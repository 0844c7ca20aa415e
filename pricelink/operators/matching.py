"""Matching products over stores: saved relations first, then equal keys, then similar names.

Stores are taken in order. Each item of a store proposes to one cluster: the first one with the same key, else the most
similar one, if it is similar enough and ahead of the runner-up; a cluster takes its best proposal, and all other items
open clusters of their own. Similar pairs come from joins on shared tokens, which lose nothing: without a shared token (a
number token where both names have some) a score cannot reach threshold - margin. Pairs that share a number and two rare
tokens are scored first; of the others only those are met that can still be the best or second of their item.

Clusters are two long tables: clusters (cluster_id, phase, ord, sub, source, given_name) in the order (phase, ord, sub),
and members (cluster_id, store, product_key, product_name, price, score, source).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import FEATURES, with_features
from ..functions.similarity import EQUAL, char_counts, open_pairs, with_score
from ..functions.text import clean_text, normalize_key, valid_price
from ..sources.tables import staged
from . import report
from .catalog import build_catalog, name_lookup

THRESHOLD, MARGIN = 0.50, 0.06
#: The best score without any shared token, by scorer.
BEST_WITHOUT_TOKEN = {"v2": 0.35, "legacy": 0.0}
ORDER = ["phase", "ord", "sub"]
#: Texts of items that meet the members of one token in one task, and pairs that a join without tokens may make.
DEALT = 1000
#: A token in more than one of so many texts is common: it selects little.
COMMON = 4
MAX_PAIRS = 10**9


def resolve_manual(catalog: DataFrame, manual: DataFrame) -> DataFrame:
    """Saved relations (manual_ord, product_name, store_pos, store, ref) with the product that each reference names, by
    key, else by normalised name."""
    rows = manual.withColumn("ref", clean_text(F.col("ref"))).where("ref <> ''")
    keys = catalog.select("store", F.col("product_key").alias("ref"), F.col("product_key").alias("by_key"))
    names = name_lookup(catalog).select("store", "norm_name", F.col("product_key").alias("by_name"))
    found = rows.join(keys, ["store", "ref"], "left").withColumn("norm_name", normalize_key(F.col("ref"))).join(names, ["store", "norm_name"], "left")
    found = found.withColumn("product_key", F.coalesce("by_key", "by_name")).where("product_key is not null")
    return found.join(catalog.select("store", "product_key", F.col("product_name").alias("item_name"), "price"), ["store", "product_key"]).select(
        "manual_ord", "product_name", "store_pos", "store", "product_key", "item_name", "price")


def claim_manual(catalog: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): a product belongs to the first saved relation that names it."""
    first = Window.partitionBy("store", "product_key").orderBy("manual_ord", "store_pos")
    per_row = Window.partitionBy("manual_ord", "store").orderBy("store_pos")
    taken = resolve_manual(catalog, manual).withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_k", F.row_number().over(per_row)).where("_k = 1")
    ident = F.concat(F.lit("m"), F.col("manual_ord").cast("string"))
    members = taken.select(ident.alias("cluster_id"), "store", "product_key", F.col("item_name").alias("product_name"), valid_price(F.col("price")).alias("price"), F.lit(1.0).alias("score"), F.lit("manual").alias("source"))
    given = clean_text(F.first("product_name"))
    opener = F.min_by("item_name", "store_pos")
    clusters = taken.groupBy("manual_ord").agg(F.when(given != "", given).otherwise(opener).alias("given_name")).select(
        F.concat(F.lit("m"), F.col("manual_ord").cast("string")).alias("cluster_id"), F.lit(0).alias("phase"), F.col("manual_ord").cast("long").alias("ord"), F.lit("").alias("sub"), F.lit("manual").alias("source"), "given_name")
    return clusters, members


def remaining(catalog: DataFrame, members: DataFrame) -> DataFrame:
    """Catalog items that no saved relation has claimed."""
    return catalog.join(members.where("source = 'manual'").select("store", "product_key"), ["store", "product_key"], "left_anti")


def same_key(items: DataFrame, open_members: DataFrame) -> DataFrame:
    """store, product_key and the first cluster that holds a member of another store with that key."""
    keys = open_members.select("product_key", "cluster_id", *ORDER)
    found = items.join(keys, "product_key").groupBy("store", "product_key").agg(F.min_by("cluster_id", F.struct(*ORDER)).alias("cluster_id"))
    return found.withColumns({"score": F.lit(1.0), "second": F.lit(0.0)})


def distinct_texts(df: DataFrame, p: str) -> DataFrame:
    """One row for each text and its states, with the features; of members also `b_first`, the first of the clusters that
    hold the text."""
    ident = ["canonical_text", "states"]
    rest = [F.first(c).alias(c) for c in FEATURES if c not in ident]
    first = [F.min("cluster_id").alias("first")] if p == "b" else []
    texts = df.groupBy(*ident).agg(*rest, *first)
    return texts.select(*[F.col(c).alias(f"{p}_{c}") for c in [*FEATURES, *(["first"] if first else [])]])


def text_sides(items: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of items (a_) and members (b_) with char_counts and `rare`, the tokens without a digit that are in fewer
    than one in COMMON texts. At most COMMON times the mean number of tokens are not rare, so these fit in one value."""
    sides = {p: staged(distinct_texts(df, p).withColumn(f"{p}_chars", char_counts(F.col(f"{p}_canonical_text"))), f"texts_{p}") for p, df in (("a", items), ("b", members))}
    every = sides["a"].select(F.col("a_tokens").alias("_t")).unionByName(sides["b"].select(F.col("b_tokens").alias("_t")))
    counts = every.select(F.explode("_t").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    common = F.array(*[F.lit(r["_t"]) for r in counts.where(F.col("_n") * COMMON >= every.count()).collect()]).cast("array<string>")
    return tuple(sides[p].withColumn(f"{p}_rare", F.sort_array(F.array_except(F.array_except(f"{p}_tokens", f"{p}_numbers"), common))) for p in "ab")


def meeting(left: DataFrame, right: DataFrame, keys: str) -> DataFrame:
    """Pairs (a, b) that share a key of the arrays a_<keys>, b_<keys>, each at its first shared key, so nothing is left to drop
    later. The items of a frequent key are dealt to as many tasks as its frequency needs, each with all members of it."""
    each = left.withColumn("_t", F.explode(f"a_{keys}"))
    salts = each.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("_salts"))
    dealt = each.join(salts, "_t").withColumn("_salt", F.pmod(F.xxhash64("a_canonical_text", "a_states"), F.col("_salts")).cast("int")).drop("_salts")
    every = right.withColumn("_t", F.explode(f"b_{keys}")).join(salts, "_t").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    once = F.col("_t") == F.array_min(F.array_intersect(f"a_{keys}", f"b_{keys}"))
    return dealt.join(every, ["_t", "_salt"]).where(once).drop("_t", "_salt")


def seed_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that share a number and two rare tokens, by a join on all three."""

    def keys(side: str) -> Column:
        rare = F.col(f"{side}_rare")
        twos = F.flatten(F.transform(rare, lambda x, i: F.transform(F.slice(rare, i + 2, F.greatest(F.lit(0), F.size(rare) - i - 1)), lambda y: F.concat_ws(" ", x, y))))
        return F.flatten(F.transform(F.col(f"{side}_numbers"), lambda n: F.transform(twos, lambda t: F.concat_ws(" ", n, t))))

    return meeting(a.withColumn("a_keys", keys("a")), b.withColumn("b_keys", keys("b")), "keys").drop("a_keys", "b_keys")


def ceiling(scorer: str) -> Column:
    """The most that a pair with at most one rare token in common can score, from the sizes of both sides."""
    n, other, strong, plain, length = ({p: F.col(f"{p}_{c}") for p in "ab"} for c in ("n", "other", "n_strong", "n_plain", "length"))
    both = F.least(F.lit(1.0), (1 + F.least(*other.values())) / F.greatest(F.lit(1), F.least(*n.values())))
    ratio = F.least(F.lit(1.0), 2 * F.least(*length.values()) / F.greatest(F.lit(1), length["a"] + length["b"]))
    if scorer == "legacy":
        return 0.75 * both + 0.13 + 0.25 * ratio
    overlap = F.least(F.lit(1.0), (1 + F.least(*plain.values())) / F.greatest(F.lit(1), F.least(*strong.values())))
    return 0.44 * both + 0.26 * overlap + 0.07 + F.when(F.col("a_kinds") > 0, 0.05).otherwise(0.0) + 0.30 * ratio


def sizes(side: str) -> list[Column]:
    """What `ceiling` needs of a text."""
    tokens, strong, rare = (F.col(f"{side}_{c}") for c in ("tokens", "strong", "rare"))
    kinds = [F.size("a_categories").alias("a_kinds")] if side == "a" else []
    return [F.size(tokens).alias(f"{side}_n"), (F.size(tokens) - F.size(rare)).alias(f"{side}_other"), F.size(strong).alias(f"{side}_n_strong"),
        F.size(F.array_except(strong, rare)).alias(f"{side}_n_plain"), F.length(f"{side}_canonical_text").alias(f"{side}_length"), *kinds]


SIZES = ["n", "other", "n_strong", "n_plain", "length"]


def other_pairs(a: DataFrame, b: DataFrame, scorer: str) -> DataFrame:
    """Pairs that share a number but at most one rare token, and may score `a_floor`. Members are first taken together by
    number and sizes: most of these groups cannot reach an item's floor, and only members of the others are met."""
    groups = b.select(F.explode("b_numbers").alias("_t"), *sizes("b")).distinct()
    wanted = a.select("a_canonical_text", "a_states", "a_floor", F.explode("a_numbers").alias("_t"), *sizes("a")).join(groups, "_t").where(ceiling(scorer) >= F.col("a_floor") - 1e-9)
    wanted = wanted.select("a_canonical_text", "a_states", "_t", *[f"b_{c}" for c in SIZES])
    items = wanted.join(a, ["a_canonical_text", "a_states"])
    held = b.select("*", F.explode("b_numbers").alias("_t"), *sizes("b"))
    once = (F.col("_t") == F.array_min(F.array_intersect("a_numbers", "b_numbers"))) & (F.size(F.array_intersect("a_rare", "b_rare")) < 2)
    met = items.join(held, ["_t", *[f"b_{c}" for c in SIZES]]).where(once)
    return met.select(*a.columns, *b.columns)


IDENT = ["a_canonical_text", "a_states", "b_canonical_text", "b_states"]


def scored_pairs(pairs: DataFrame, scorer: str, ratio: str, floor: float | None) -> DataFrame:
    """IDENT, b_first and score of the pairs that may be best or second of their item. The text ratio is dealt to all tasks,
    the pairs of one member text side by side."""
    extra = ["a_floor"] if "a_floor" in pairs.columns else []
    bounds = open_pairs(pairs, scorer, floor).select(*IDENT, *extra, "b_first", "_possible", "_without", "_least", "_low", "_high")
    if extra:
        bounds = bounds.where(F.col("_high") >= F.col("a_floor") - 1e-9)
    found = contenders(bounds)
    if ratio != EQUAL:
        n_tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = found.repartition(n_tasks, F.col("b_canonical_text"), F.pmod(F.xxhash64("a_canonical_text"), F.lit(8))).sortWithinPartitions("b_canonical_text")
    least = F.lit(-1.0) if floor is None else F.lit(floor - 1e-9)
    return with_score(found, scorer, ratio).where((F.col("score") > 0) & (F.col("score") >= least)).select(*IDENT, "b_first", "score")


def blocked_scores(items: DataFrame, members: DataFrame, scorer: str, ratio: str, floor: float) -> DataFrame:
    """IDENT and score of all pairs of texts that may be best or second of their item and reach `floor`.

    Seeds, pairs that share a number and two rare tokens, are scored first. An item's floor is then the score of the second
    of its clusters, or `floor`; any other pair must be able to reach that. Where one name has no number, a pair is met at
    any shared token."""
    a, b = text_sides(items, members)
    seeds = staged(scored_pairs(seed_pairs(a, b), scorer, ratio, floor), "seeds")
    item = ["a_canonical_text", "a_states"]
    best = seeds.groupBy(*item).agg(F.max(F.struct("score", "b_first")).alias("_best"))
    second = seeds.join(best, item).where(F.col("b_first") != F.col("_best.b_first")).groupBy(*item).agg(F.max("score").alias("_second"))
    floored = a.join(second, item, "left").withColumn("a_floor", F.greatest(F.lit(floor), F.coalesce("_second", F.lit(0.0)))).drop("_second")
    numbered, plain = F.size("a_numbers") > 0, b.where(F.size("b_numbers") == 0)
    rest = other_pairs(floored.where(numbered), b, scorer).unionByName(meeting(floored.where(~numbered), b, "tokens")).unionByName(meeting(floored.where(numbered), plain, "tokens"))
    return seeds.select(*IDENT, "score").unionByName(scored_pairs(rest, scorer, ratio, floor).select(*IDENT, "score"))


def all_pairs(items: DataFrame, members: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """Every pair of texts; for thresholds so low that names without a shared token may match. Their number is the product
    of both sides', so it is bounded."""
    a, b = distinct_texts(items, "a"), distinct_texts(members, "b")
    n = a.count() * b.count()
    if n > most:
        raise ValueError(f"{n} pairs of texts without a token to join on; raise the threshold, or the bound of {most}")
    warnings.warn(f"{n} pairs of texts are compared, as at this threshold names without a shared token may match", stacklevel=2)
    return a.crossJoin(b)


def contenders(pairs: DataFrame) -> DataFrame:
    """Open pairs that may be the best or the second of their item: those whose highest score is not below the lowest
    score of the second of its clusters."""
    item = Window.partitionBy("a_canonical_text", "a_states")
    best = F.max(F.struct("_low", "b_first")).over(item)
    second = F.max(F.when(F.col("b_first") != F.col("_best.b_first"), F.col("_low"))).over(item)
    return pairs.withColumn("_best", best).withColumn("_second", second).where(F.col("_high") >= F.coalesce("_second", F.lit(0.0)) - 1e-9)


def best_candidates(items: DataFrame, members: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, scorer: str = "v2", ratio: str = "difflib", blocked: bool = True) -> DataFrame:
    """store, product_key, cluster_id, score, second for each item with a candidate of threshold - margin or more; what
    scores less decides nothing and counts as no candidate. `items`: one store's items with features; `members`: members of
    clusters without that store, with features and the cluster's order."""
    exact = same_key(items, members)
    fuzzy_items = items.join(exact.select("store", "product_key"), ["store", "product_key"], "left_anti")
    floor = threshold - margin
    if blocked and floor > BEST_WITHOUT_TOKEN[scorer]:
        scored = blocked_scores(fuzzy_items, members, scorer, ratio, floor)
    else:
        scored = scored_pairs(all_pairs(fuzzy_items, members), scorer, ratio, None).where(F.col("score") >= floor - 1e-9).select(*IDENT, "score")
    texts = fuzzy_items.select("store", "product_key", F.col("canonical_text").alias("a_canonical_text"), F.col("states").alias("a_states"))
    held = members.select("cluster_id", *ORDER, F.col("canonical_text").alias("b_canonical_text"), F.col("states").alias("b_states"))
    each = texts.join(scored, ["a_canonical_text", "a_states"]).join(held, ["b_canonical_text", "b_states"])
    by_cluster = each.groupBy("store", "product_key", "cluster_id", *ORDER).agg(F.max("score").alias("score"))
    rank = Window.partitionBy("store", "product_key").orderBy(F.desc("score"), *ORDER)
    ranked = by_cluster.withColumn("second", F.lead("score", 1, 0.0).over(rank)).withColumn("_n", F.row_number().over(rank)).where("_n = 1")
    return exact.unionByName(ranked.select("store", "product_key", "cluster_id", "score", "second"))


def assign(best: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """The eligible proposal of the highest score for each cluster, the first key on a tie."""
    eligible = best.where((F.col("score") >= threshold) & (F.col("score") - F.col("second") >= margin))
    rank = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "product_key")
    return eligible.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


@dataclass
class Bundle:
    """What a comparison gives: clusters, members, and the tables made of them."""

    stores: list[str]
    clusters: DataFrame
    members: DataFrame

    def named(self) -> DataFrame:
        return report.named_clusters(self.clusters, self.members)

    def comparison(self) -> DataFrame:
        return report.comparison(self.named(), self.members, self.stores)

    def relations(self) -> DataFrame:
        return report.relations_wide(self.named(), self.members, self.stores)

    def relation_rows(self) -> DataFrame:
        return report.relation_rows(self.named(), self.members, self.stores)

    def ranking(self) -> DataFrame:
        return report.ranking(self.members, self.stores)


EMPTY = "cluster_id string, phase int, ord long, sub string, source string, given_name string"
EMPTY_MEMBERS = "cluster_id string, store string, product_key string, product_name string, price double, score double, source string"


def compare(listings: DataFrame, stores: list[str], manual: DataFrame | None = None, threshold: float = THRESHOLD, margin: float = MARGIN, scorer: str = "v2", ratio: str = "difflib", blocked: bool = True) -> Bundle:
    """Match the listings of `stores`, in that order. One round a store (a few stores; about fifty is the sensible
    limit); each round's tables are written, so plans stay short and lost executors cost one round."""
    if not stores:
        raise ValueError("no stores to compare")
    spark = listings.sparkSession
    catalog = staged(build_catalog(listings), "catalog")
    if manual is None:
        clusters, members = spark.createDataFrame([], EMPTY), spark.createDataFrame([], EMPTY_MEMBERS)
    else:
        clusters, members = claim_manual(catalog, manual)
        clusters, members = staged(clusters, "clusters"), staged(members, "members")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = catalog.select("product_name").repartition(n_tasks, "product_name").distinct()
    features = staged(with_features(names, legacy=scorer == "legacy"), "features")
    open_items = remaining(catalog, members)
    done_clusters, done_members = [clusters], [members]
    for n, store in enumerate(stores):
        items = open_items.where(F.col("store") == store).join(features, "product_name")
        here = members.where(F.col("store") == store).select("cluster_id")
        held = members.join(here, "cluster_id", "left_anti").join(clusters.select("cluster_id", *ORDER), "cluster_id").join(features, "product_name")
        won = assign(best_candidates(items, held, threshold, margin, scorer, ratio, blocked), threshold, margin)
        plain = items.select("store", "product_key", "product_name", valid_price(F.col("price")).alias("price"))
        joined = plain.join(won.select("store", "product_key", "cluster_id", "score"), ["store", "product_key"], "left")
        fresh = F.concat_ws(":", F.lit(f"s{n}"), F.col("product_key"))
        new_members = staged(joined.select(F.coalesce("cluster_id", fresh).alias("cluster_id"), F.col("cluster_id").isNull().alias("opens"), "store", "product_key", "product_name", "price", F.coalesce("score", F.lit(1.0)).alias("score"), F.lit("auto").alias("source")), f"members{n}")
        new_clusters = new_members.where("opens").select("cluster_id", F.lit(1).alias("phase"), F.lit(n).cast("long").alias("ord"), F.col("product_key").alias("sub"), F.lit("auto").alias("source"), F.col("product_name").alias("given_name"))
        done_clusters.append(new_clusters)
        done_members.append(new_members.drop("opens"))
        clusters, members = clusters.unionByName(new_clusters), members.unionByName(done_members[-1])
    return Bundle(stores, clusters, members)
