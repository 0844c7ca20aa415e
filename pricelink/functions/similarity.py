"""Similarity of product names as column expressions; the sequence ratio runs in a vectorised helper.

score_pairs takes pairs of features (columns with prefixes a_ and b_; the order matters for the text ratio) and adds
`score`. The ratio runs only for pairs that the other rules leave open, once for each distinct pair of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import FEATURES, shared, state_conflict


#: Bits of a word of the bit-parallel subsequence: sums of two words and a carry stay below 2 ** 63.
WORD_BITS = 62
FULL = (1 << WORD_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, bit-parallel: words of 62 places of a, in which a zero says
    that a character of b lengthens the subsequence there; each character of b is one addition with carry."""
    one, n = F.lit(1).cast("long"), F.length(a)
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / F.lit(WORD_BITS)).cast("int")))
    bits = lambda w: F.call_function("shiftleft", one, F.least(F.lit(WORD_BITS), n - w * WORD_BITS)) - 1

    def masks(chars: Column) -> Column:
        def mask(c: Column, w: Column) -> Column:
            part = F.slice(chars, w * WORD_BITS + 1, F.lit(WORD_BITS))
            places = F.transform(part, lambda x, i: F.when(x == c, F.call_function("shiftleft", one, i)).otherwise(0))
            return F.aggregate(places, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

        kinds = F.array_distinct(chars)
        return F.map_from_arrays(kinds, F.transform(kinds, lambda c: F.transform(words, lambda w: mask(c, w))))

    def step(v: Column, m: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("words"))

        def add(acc: Column, x: Column) -> Column:
            total = x["v"] + x["v"].bitwiseAND(x["m"]) + acc["carry"]
            word = total.bitwiseAND(F.lit(FULL).cast("long")).bitwiseOR(x["v"].bitwiseAND(F.bitwise_not(x["m"])))
            return F.struct(F.shiftrightunsigned(total, WORD_BITS).alias("carry"), F.concat(acc["words"], F.array(word)).alias("words"))

        return F.aggregate(F.zip_with(v, m, lambda x, y: F.struct(x.alias("v"), y.alias("m"))), start, add)["words"]

    def zeros(full: Column, held: Column) -> Column:
        met = F.filter(F.transform(F.split(b, ""), lambda c: F.try_element_at(held, c)), lambda m: m.isNotNull())
        ones = F.zip_with(F.aggregate(met, full, step), full, lambda v, f: F.bit_count(v.bitwiseAND(f)))
        return n - F.aggregate(ones, F.lit(0), lambda x, y: x + y)

    chars = F.filter(F.split(a, ""), lambda x: x != "")
    return let(F.transform(words, bits), lambda full: let(let(chars, masks), lambda held: zeros(full, held)))


#: Codes of printable ASCII characters, for which a text has a table of masks.
CODES = (32, 127)


def plain_text(text: Column) -> Column:
    return text.rlike(r"^[ -~]*$")


def lcs_masks(a: Column) -> Column:
    """What a text needs to be met by many others: for each printable ASCII character the places where it stands, as bits; null
    for texts of more than one word of bits or with other characters."""
    chars = F.filter(F.split(a, ""), lambda x: x != "")
    places = lambda cs, c: F.aggregate(F.transform(cs, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    table = lambda cs: F.transform(F.sequence(*[F.lit(c) for c in CODES]), lambda code: F.when(F.array_contains(cs, F.char(code)), places(cs, F.char(code))).otherwise(F.lit(0).cast("long")))
    return F.when(plain_text(a) & (F.length(a) <= WORD_BITS), let(chars, table))


def lcs_codes(b: Column) -> Column:
    """The places of a text's characters in a table of lcs_masks; null for texts with other than printable ASCII characters."""
    return F.when(plain_text(b), F.transform(F.filter(F.split(b, ""), lambda x: x != ""), lambda x: F.ascii(x) - CODES[0]))


def lcs_of(n: Column, masks: Column, codes: Column) -> Column:
    """lcs_length of a text of n characters with masks and one with codes: a word of bits, one addition a character."""

    def step(v: Column, code: Column) -> Column:
        held = v.bitwiseAND(F.get(masks, code))
        return (v + held).bitwiseAND(F.lit(FULL).cast("long")).bitwiseOR(v - held)

    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    return n - F.bit_count(F.aggregate(codes, full, step).bitwiseAND(full))


def lcs_ratio(a: Column, b: Column, masks: Column | None = None, codes: Column | None = None) -> Column:
    """Twice the length of the longest common subsequence over the sum of lengths; one for equal texts, null for a null. With
    the lcs_masks of a and lcs_codes of b, made once a text, the pairs that have both need no more than one pass."""
    total = F.length(a) + F.length(b)
    found = F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
    if masks is not None and codes is not None:
        found = found.when(masks.isNotNull() & codes.isNotNull(), 2 * lcs_of(F.length(a), masks, codes) / total)
    return found.when(a.isNotNull() & b.isNotNull(), 2 * lcs_length(a, b) / total)


def sequence_ratio(a: str, b: str) -> float:
    return matcher(b)(a)


@lru_cache(maxsize=4096)
def matcher(b: str) -> Callable[[str], float]:
    """The ratio of any text to b, whose index is made once."""
    held = SequenceMatcher(None, "", b)

    def ratio(a: str) -> float:
        held.set_seq1(a)
        return held.ratio()

    return ratio


#: The ratio by the longest common subsequence, in column expressions.
LCS = "lcs"
#: The ratio that needs no helper: one for equal texts, else none.
EQUAL = "equal"


def text_ratio(a: Column, b: Column, kind: str = "difflib") -> Column:
    """Ratio of two texts; equal texts and nulls never reach the loop."""
    if kind == LCS:
        return lcs_ratio(a, b)
    if kind == EQUAL:
        return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("double"))

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([None if x is None or y is None else sequence_ratio(x, y) for x, y in zip(left, right)], dtype="float64")

    # so marked, a filter on the ratio stays above it, and it is computed once, where its pairs are dealt to
    return F.when(a == b, F.lit(1.0)).otherwise(run.asNondeterministic()(F.when(a != b, a), F.when(a != b, b)))


def char_counts(text: Column) -> Column:
    """A number for each character of an ASCII text and its place among equal ones, so that the common numbers of two
    texts are the characters that they share, repeats included."""
    chars = F.array(F.sort_array(F.filter(F.split(text, ""), lambda x: x != "")))
    return F.flatten(F.transform(chars, lambda c: F.transform(c, lambda x, i: F.ascii(x).cast("long") * 2**32 + i - F.array_position(c, x))))


def once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds columns as a generator's output: they are computed once a row, in generated code of their own, and filters on
    them are not pushed below, which would repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))


def with_parts(pairs: DataFrame, scorer: str) -> DataFrame:
    """Adds the parts of the score, and `_most`: no ratio matches more characters than the shorter text has, nor, where
    pairs have char_counts, more than both texts share."""
    a, b = ({c: F.col(f"{p}_{c}") for c in FEATURES} for p in "ab")
    counts = {f"_{c}": shared(a[c], b[c]) for c in FEATURES[1:5]} | {"_clash": state_conflict(a["states"], b["states"])}
    la, lb = F.length(a["canonical_text"]), F.length(b["canonical_text"])
    matched = shared(F.col("a_chars"), F.col("b_chars")) if "a_chars" in pairs.columns else F.least(la, lb)
    possible, without, _, least = parts(scorer)
    most = F.least(F.lit(1.0), 2 * matched / F.greatest(F.lit(1), la + lb)) + 1e-9
    found = once(once(pairs, counts), {"_possible": possible, "_without": without, "_least": least, "_most": most})
    return found.drop(*counts)


def parts(scorer: str) -> tuple[Column, Column, float, Column]:
    """(possible, score without the text ratio, weight of the ratio, least ratio) of pairs with counts."""
    tokens, strong, numbers, categories = (F.col(f"_{c}") for c in FEATURES[1:5])
    na, nb = ({c: F.size(f"{p}_{c}") for c in FEATURES[1:5]} for p in "ab")
    every, least = na["tokens"] + nb["tokens"] - tokens, F.least(na["tokens"], nb["tokens"])
    jaccard = F.when(every == 0, 0.0).otherwise(tokens / every)
    containment = F.when(least == 0, 0.0).otherwise(tokens / least)
    numbers_differ = (na["numbers"] > 0) & (nb["numbers"] > 0) & (numbers == 0)
    some = least > 0
    if scorer == "legacy":
        possible = some & ~numbers_differ & ((strong > 0) | (numbers > 0))
        score = 0.50 * F.greatest(jaccard, containment) + 0.25 * jaccard
        score = score + F.when(numbers > 0, 0.08).otherwise(0.0) + F.when(strong >= 2, 0.05).otherwise(0.0)
        return possible, score, 0.25, F.lit(0.0)
    possible = some & ~F.col("_clash") & ~numbers_differ
    overlap = strong / F.greatest(F.lit(1), F.least(na["strong"], nb["strong"]))
    score = 0.44 * F.greatest(jaccard, containment) + 0.26 * overlap
    score = score + F.when(numbers > 0, 0.07).otherwise(0.0)
    both = (na["categories"] > 0) & (nb["categories"] > 0)
    score = score + F.when(both & (categories > 0), 0.05).when(both, -0.22).otherwise(0.0)
    return possible, score, 0.30, F.when((strong == 0) & (tokens < 2), 0.78).otherwise(0.0)


def open_pairs(pairs: DataFrame, scorer: str = "v2", at_least: float | None = None) -> DataFrame:
    """Pairs with the parts of their score, and `_low` and `_high`, what the score is between whatever the ratio. Pairs that
    cannot reach `at_least` are left out where it is given."""
    weight = parts(scorer)[2]
    found = with_parts(pairs, scorer)
    if at_least is not None:
        found = found.where(F.col("_possible") & (F.col("_most") >= F.col("_least")) & (F.col("_without") + weight * F.col("_most") >= at_least - 1e-9))
    low = F.when(F.col("_possible") & (F.col("_least") <= 0), F.col("_without")).otherwise(0.0)
    return found.withColumns({"_low": F.greatest(F.lit(0.0), F.least(F.lit(1.0), low)), "_high": F.when(F.col("_possible"), F.col("_without") + weight * F.col("_most")).otherwise(0.0)})


def with_score(pairs: DataFrame, scorer: str = "v2", ratio: str = "difflib") -> DataFrame:
    """Adds `score` (0 to 1) to open pairs."""
    text = [F.when(F.col("_possible"), F.col(f"{p}_canonical_text")) for p in "ab"]
    found = pairs.withColumn("_ratio", text_ratio(*text, ratio))
    score = F.when(~F.col("_possible") | (F.col("_ratio") < F.col("_least")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_without") + parts(scorer)[2] * F.col("_ratio"))))
    return found.withColumn("score", F.coalesce(score, F.lit(0.0)))


def score_pairs(pairs: DataFrame, scorer: str = "v2", ratio: str = "difflib", at_least: float | None = None) -> DataFrame:
    """Adds `score` (0 to 1). Pairs that cannot reach `at_least` are left out where it is given."""
    return with_score(open_pairs(pairs, scorer, at_least), scorer, ratio).select(*pairs.columns, "score")
