"""Text and number rules as Column functions; all of them run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of prices, and the shape of their numbers.
UNITS = "CS|EA|LB|CT|PK|BX|BG|RL|DZ"
NUMBER = r"-?\d{1,5}(?:\.\d+)?"

#: Texts that stand for a missing relation, and colours of the price scale from best to worst.
PLACEHOLDERS = ["-", "--", "—", "n/a", "na", "none", "null", "sin dato", "s/d"]
COLOURS = ["FF00C800", "FF1ACE1A", "FF33D333", "FF4CD84C", "FF66DE66", "FF80E480", "FF99E999", "FFB2EEB2", "FFCCF4CC", "FFE6FAE6", "FFFFFFFF"]


def empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(empty(c), r"(?U)[\s\x1c-\x1f]+", " "))


def tidy(c: Column) -> Column:
    """clean_text of a column, with its slow pattern only for texts that are not plain words between single spaces."""
    return F.when(c.rlike(r"[^ -~]|^ |  | \z"), clean_text(c)).otherwise(empty(c))


def has_text(c: Column) -> Column:
    """Whether clean_text leaves anything."""
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """Non-ASCII characters whose compatibility decomposition has one ASCII character (two aligned strings), and those
    with more (a map)."""
    single, to, several = [], [], {}
    for i in range(128, 0x1FBFA):
        plain = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append(chr(i))
            to.append(plain)
        elif plain:
            several[chr(i)] = plain
    return "".join(single), "".join(to), several


def char_class(chars: Iterable[str]) -> str:
    """A pattern for one of some characters beyond ASCII, neighbours as ranges: a pattern tests its ranges one by one."""
    points = sorted(map(ord, chars))
    starts = [p for n, p in enumerate(points) if n == 0 or points[n - 1] != p - 1]
    ends = [p for n, p in enumerate(points) if n + 1 == len(points) or points[n + 1] != p + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


def ascii_only(c: Column) -> Column:
    """Letters without accents, compatibility forms spelled out, and all else beyond ASCII dropped."""
    single, to, several = decompositions()
    marks = char_class(several)
    # two literals that fold to a map; only characters beyond ASCII are looked up in it
    spelled = F.map_from_arrays(*[F.split(F.lit("\n".join(side)), "\n") for side in (several, several.values())])
    other = lambda x: F.when(x > "\x7f", F.coalesce(F.try_element_at(spelled, x), x)).otherwise(x)
    beyond = F.regexp_replace(c, r"[\x00-\x7f]+", "")
    whole = F.when(beyond.rlike(marks), F.array_join(F.transform(F.split(c, ""), other), "")).otherwise(c)
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(F.regexp_replace(F.translate(whole, single, to), r"[^\x00-\x7f]+", ""))


def normalize_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between runs of them."""
    return F.trim(F.regexp_replace(F.lower(ascii_only(empty(c))), r"[^a-z0-9]+", " "))


def number_in(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("double")


def to_numeric(c: Column) -> Column:
    """The first number of a text, thousands separators removed; null if there is none."""
    return number_in(F.translate(c.cast("string"), ",", ""), r"(-?\d+(?:\.\d+)?)")


def price_candidate(c: Column) -> Column:
    """struct(price, unit): a number with a unit, else one behind a $ sign, else a text that is a number; null if none."""
    plain = F.translate(clean_text(c), ",", "")
    with_unit = rf"(?i)\$?\s*({NUMBER})\s*/?\s*({UNITS})\b"
    unit = F.upper(F.regexp_extract(plain, with_unit, 2))
    price = F.coalesce(number_in(plain, with_unit), number_in(plain, rf"\$\s*({NUMBER})"), number_in(plain, rf"^\s*({NUMBER})\s*$"))
    return F.when(price.isNotNull(), F.struct(price.alias("price"), unit.alias("unit")))


def list_line(c: Column) -> Column:
    """struct(product_name, price) of a line `item pack size ... name $price UNIT`; null for other lines."""
    text = clean_text(c)
    shape = rf"(?i)^(.*?)\$?(\d{{1,5}}(?:,\d{{3}})*(?:\.\d+)?)\s*(?:{UNITS})\s*$"
    left = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, shape, 1)), r"[_-]+\s*$", ""))
    found = F.split(left, " +")
    tail = F.slice(found, F.lit(4), F.greatest(F.size(found) - 3, F.lit(0)))
    name = F.array_join(F.when(F.size(tail) >= 2, F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0)))).otherwise(tail), " ")
    price = F.translate(F.regexp_extract(text, shape, 2), ",", "").try_cast("double")
    ok = text.rlike(r"^\d{4,}\b") & ~normalize_key(text).contains("item pack pack size") & price.isNotNull() & (F.size(found) >= 4) & (name != "")
    return F.when(ok, F.struct(name.alias("product_name"), price.alias("price")))


def relation_value(c: Column) -> Column:
    """The cleaned text; empty for placeholders and for texts without letters or digits."""
    text = clean_text(c)
    return F.when(F.lower(text).isin(PLACEHOLDERS) | (normalize_key(text) == ""), "").otherwise(text)


def valid_price(c: Column) -> Column:
    """Positive finite prices, else null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def currency_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(valid_price(c), 2)), F.lit(""))


def step_colour(step: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in COLOURS]), F.greatest(F.lit(0), F.least(F.lit(10), step.cast("int"))))


def is_product_header(c: Column) -> Column:
    key = normalize_key(c)
    return key.contains("product description") | key.contains("product name") | key.isin("description", "item description")


def is_price_header(c: Column) -> Column:
    key = normalize_key(c)
    return key.contains("price") | key.contains("cost")


def product_id(c: Column) -> Column:
    return F.regexp_extract(empty(c), r"\b\d{5,8}\b", 0)


def provider_key(c: Column) -> Column:
    """sysco, kohl or usfood from a store's name; null for others."""
    key = normalize_key(c)
    parts = F.split(key, " ")
    us = F.array_contains(parts, "usfoods") | (F.array_contains(parts, "us") & F.arrays_overlap(parts, F.array(F.lit("food"), F.lit("foods"))))
    return F.when(key.contains("sysco"), "sysco").when(key.contains("kohl"), "kohl").when(us, "usfood")


def detect_provider(c: Column) -> Column:
    """KOHL, US FOOD or SYSCO if a text names one of them, in this order; null if none."""
    key = normalize_key(c)
    return F.when(key.contains("kohl"), "KOHL").when(key.contains("us food") | key.contains("usfoods"), "US FOOD").when(key.contains("sysco"), "SYSCO")
