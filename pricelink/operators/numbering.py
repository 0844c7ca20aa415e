"""Consecutive numbers over a whole table or its groups, without a window that one task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Ranges of the order column that are numbered apart. Only their counts are ordered together.
RANGES = 4096
#: Bits of a row's place within its partition in monotonically_increasing_id.
PLACE_BITS = 33


def with_numbers(df: DataFrame, order: str, out: str, ranges: int = RANGES) -> DataFrame:
    """Adds `out`: 1, 2, 3, ... in the order of a distinct integer column. Its span is cut into ranges; a row's number is
    the count of the ranges before its own and its place within it."""
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high"))
    span = ends.select(F.struct("low", "high")).scalar()
    width = F.greatest(F.lit(1.0), (span["high"] - span["low"] + 1) / F.lit(float(ranges)))
    rows = df.withColumn("_range", F.floor((F.col(order) - span["low"]) / width).cast("int"))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return rows.withColumn("_place", place).join(starts, "_range").withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str, size: str | None = None) -> DataFrame:
    """Adds `out`: 1, 2, 3, ... within each group (null is a group) in any order, and `size`, the rows of the group.

    Rows are sorted by (group, order) over sampled ranges and written, so no task holds a group. A row's number is that
    over the whole table, less that of the first row of its group; only one count a range is ordered in one place. Rows
    that agree in all of the order are numbered in any order.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_by = [*keys, *order]
    rows = staged(df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_part", part).withColumn("_place", place).join(starts, "_part").withColumn("_number", F.col("_start") + F.col("_place") + 1)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not group:
        return numbered.select(*columns, F.col("_number").alias(out), *([F.lit(rows.count()).cast("long").alias(size)] if size else []))
    firsts = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("_size"))
    firsts = firsts.withColumn("_part0", part).withColumn("_before", place).drop("_at").join(starts.toDF("_part0", "_start0"), "_part0").withColumn("_before", F.col("_start0") + F.col("_before"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(firsts, on).select(*columns, (F.col("_number") - F.col("_before")).alias(out), *([F.col("_size").alias(size)] if size else []))
