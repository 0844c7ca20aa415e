"""Small shared pieces: words, written tables, and running totals that no single task has to hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words (runs of non-space characters) of a text, an empty array for null."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def without_spaces(text: Column) -> Column:
    return F.translate(text_or_empty(text), SPACES, "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, one of our own, but only if the driver is
    the only machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
        found = _own[context.applicationId]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(taken: list[str], name: str) -> str:
    """A column name like `name` that is none of `taken`."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """At most `most` bytes in an Arrow batch, so that a worker's memory does not hold thousands of long texts. The
    session keeps the setting, as results are lazy; a lower one is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, most)


def unit_hash(*cols: Column | str) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, share: Column) -> DataFrame:
    """Exclusive running sum of `value` within `group` along a hash order of the `order` columns.

    A group is dealt into buckets by the hash of the order columns: about four a shuffle partition over all
    groups, by the group's `share` of the rows. A window runs within each bucket and starts from the sum of the
    buckets before it, so a group with a third of all rows is spread as evenly as the others. Only the bucket
    sums (a number set by the shuffle partitions, not by the rows) are ordered together. Rows that agree in all
    order columns are interchangeable.
    """
    spark = df.sparkSession
    n = F.greatest(F.lit(1), F.ceil(share * 4 * shuffle_partitions(spark)))
    rows = df.withColumn("_u", unit_hash(F.lit(value), *order)).withColumn("_bucket", F.floor(F.col("_u") * n))
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    starts = sums.select(*keys, F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    on = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_u", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, on)
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_u", "_bucket", "_b", "_start", *[f"_g{i}" for i in range(len(group))])
    )


BLOOM_BITS = 6
KEYS_PER_BLOCK = 4
#: 64 bits each: at most 2 MB of filter. Beyond 4 * MAX_BLOCKS keys more rows pass it.
MAX_BLOCKS = 1 << 18


def block_and_mask(h: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a 64-bit hash in a blocked Bloom filter, and its bits in the block."""
    g = F.xxhash64(h, F.lit(1))
    bits = F.lit(0).cast("long")
    for i in range(BLOOM_BITS):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return F.pmod(h, F.lit(blocks).cast("long")).cast("int"), bits


def bloom_filter(hashes: DataFrame, n: int, max_blocks: int = MAX_BLOCKS) -> tuple[Column, int]:
    """(array of the filter's blocks as a scalar subquery, number of blocks) for `n` hashes in a column `h`."""
    blocks = max(1, min(max_blocks, -(-n // KEYS_PER_BLOCK)))
    block, bits = block_and_mask(F.col("h"), blocks)
    filled = hashes.select(block.alias("block"), bits.alias("bits"))
    empty = hashes.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("bits"))
    every = filled.union(empty).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: x["bits"]).alias("bits")).scalar(), blocks


def may_hold(bits: Column, blocks: int, h: Column) -> Column:
    block, mask = block_and_mask(h, blocks)
    return F.get(bits, block).bitwiseAND(mask) == mask


def may_meet(rows: DataFrame, key: Column, others: DataFrame, other: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key surely is none of the others', rows whose key may be one of them), by a Bloom filter of bounded
    size: what is no partner of a small table needs no shuffle. A full filter costs time, never rows."""
    hashes = others.select(F.xxhash64(other).alias("h")).distinct()
    bits, blocks = bloom_filter(hashes, others.count())
    name = spare(rows.columns, "_bloom")
    probed = rows.withColumn(name, bits)
    hit = may_hold(F.col(name), blocks, F.xxhash64(key))
    return probed.where(~hit).drop(name), probed.where(hit).drop(name)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which Spark does not hash, go by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def left_out(docs: DataFrame, key: Column, touched: DataFrame) -> DataFrame:
    """docs without the rows of `touched` (id, key, stays: equal to doc_id and the key of a row) that do not stay; of the
    touched rows that stay, one for each id and key. A row whose doc_id surely is not touched is not shuffled, and its
    key is not computed. `touched` is a written table."""
    sure, maybe = may_meet(docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), key.alias("_key")), F.col("_id"), touched, F.col("id"))
    joined = maybe.join(touched, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
    untouched, repeated = joined.where("stays is null"), joined.where("stays").dropDuplicates(["_id", "_key"])
    return sure.select("doc.*").union(untouched.select("doc.*")).union(repeated.select("doc.*"))
