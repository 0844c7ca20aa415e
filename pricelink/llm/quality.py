"""Quality rules as a bitmask ledger.

The ledger measures every text once and keeps the measurements and one long of failure bits, bit i for rule i.
Policies are versioned masks over the ledger: a document fails a policy if it fails any rule of its mask. Changing
a policy, or asking what a rule does (`ablation`), reads the ledger only, never the texts again.

Words are runs of non-space characters; a null or empty text has none and fails `few_words` only. All is computed
within the row, so repeated rows, hot groups and clashing columns do not matter; an empty table gives an empty
ledger. Texts of any length are read whole; the arrays of a row grow with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10



def rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("few_words", c("n_words") < MIN_WORDS),
        ("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("upper_case", (c("n_letters") >= 20) & (10 * c("n_upper") > 3 * c("n_letters"))),
        ("repeated_lines", (c("n_lines") >= 5) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        ("word_length", (c("n_words") >= MIN_WORDS) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")))),
    ]


#: Version of a policy -> the names of its rules. Never change a version; add one.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "upper_case", "repeated_lines", "word_length"),
}


def mask(version: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def bind(value: Column, then) -> Column:
    """then(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def window_hashes(found: Column) -> Column:
    """A hash of each run of five words."""
    each = F.transform(found, lambda x: F.xxhash64(x))
    last = WINDOW - 1
    return bind(each, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - last, F.lit(0))), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))


def covered(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more, the first occurrence included."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = bind(pairs, lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    steps = bind(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, measurements and `failures` (long) of every document; no shuffle."""
    t = text_or_empty(F.col(text))
    measured = docs.select(*keep, t.alias("_t"), words(F.col(text)).alias("_w"))
    measured = measured.withColumn("_h", window_hashes(F.col("_w")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    full = F.length("_t")
    measured = measured.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (full - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), covered(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    measured = measured.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits)


def passes(failures: Column, version: str) -> Column:
    return failures.bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def ablation(found: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept without the rule).
    Equal masks are counted first, so what is shuffled is bounded by the number of masks."""
    names = [name for name, _ in rules()]
    masks = found.groupBy(F.col("failures").bitwiseAND(F.lit(mask(version)).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    each = masks.select("failed", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r"))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failed") == F.col("r.bit")
    return each.groupBy("r.rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only_this"))


def judged(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with base_failed and the verdict `kept` of a policy."""
    found = ledger(docs)
    base = ~passes(F.col("failures"), "base")
    kept = ~base & passes(F.col("failures"), version)
    return found.withColumn("base_failed", base).withColumn("kept", kept)
