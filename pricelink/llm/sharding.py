"""Weighted rendezvous hashing: each record goes to the shard that scores highest for its key.

A shard's score for a key is -weight / ln(u), u being a hash of key and shard in (0, 1). A key and the list of
shards decide alone, so when a shard is added only the records that move into it change place, and in proportion
to its weight. Slots number the records of a shard without gaps.

Null keys are one more key. Repeated rows are counted together before the shuffle and get a slot each. Rows that
agree in all columns that are kept are interchangeable. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_total, text_or_empty


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key.isNull(), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.lit(float(weight)) / F.ln(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key; the lower shard wins a tie. Shards of weight 0 get nothing."""
    scored = [F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return -best["minus"]


def with_slots(df: DataFrame, columns: list[str], shard: str, n_shards: int) -> DataFrame:
    """`columns` and shard of all rows, with `slot` from 0 in each shard, in a hash order of the columns."""
    counted = df.groupBy(*columns, shard).agg(F.count(F.lit(1)).alias("_copies"))
    placed = running_total(counted, [shard], columns, "_copies", "_first", F.lit(1.0 / n_shards))
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).select(*columns, shard, (F.col("_first") + F.col("_copy")).alias("slot"))


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float]) -> DataFrame:
    """Shard, slot and the shard under the `grown` weights of each document; doc_id is the key."""
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty(F.col("text"))) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(F.col("text")).cast("binary")).alias("text_crc32"),
    ).withColumn("shard", rendezvous(F.col("doc_id"), weights))
    return with_slots(rows, ["doc_id", "size", "text_crc32"], "shard", len(weights)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), grown).alias("grown_shard")
    )
