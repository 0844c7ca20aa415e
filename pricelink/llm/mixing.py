"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight, which sets how many words the mix takes from it, and a schedule, a piecewise linear
weight over the training time from 0 to 1, which sets when. The schedule's integral, scaled to the source's
target, is its cumulative demand D(t). A document that stands behind c words of its source in the source's hash
order is trained at the time t with D(t) = c; a second pass over the source stands behind all words of the first.
Sorting by that time gives the training order.

Targets: sources share the words of all sources by weight; a source that would exceed `cap` times its own size
stops there, and the others share the excess by weight until none is above (a closed form over the sources in
order of cap / weight). Full passes are taken of each document; the last pass ends at the target, within a
document if need be.

Null sources are one source, null texts have no words (and are never repeated). Rows with equal source, doc_id and
size are interchangeable. Sources without words get the target 0. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_total, written

CAP = 3.0


def ranked_sources(rows: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row a source: words, rows, rank by code point from 0 (null last) and weight 1, 2, 3, 1, 2, 3, ..."""
    found = rows.groupBy(F.col(source).alias("src")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    return found.withColumn("rank", rank).withColumn("weight", F.pmod(F.col("rank"), F.lit(3)) + 1)


def with_targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds `target` (double) to a table of src, source_size and weight."""
    whole = Window.partitionBy()
    most = F.col("source_size") * F.lit(float(cap))
    by_level = Window.orderBy("_level", "_most", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        sources.withColumn("_most", most)
        .withColumn("_level", F.col("_most") / F.col("weight"))
        .withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(by_level), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
        .withColumn("_fill", F.col("_left") / F.col("_weights"))
        .withColumn("_free", F.col("_level") > F.col("_fill"))
        .withColumn("_fill", F.max(F.when(F.col("_free"), F.col("_fill"))).over(whole))
    )
    return filled.withColumn("target", F.when(F.col("_free"), F.col("_fill") * F.col("weight")).otherwise(F.col("_most"))).drop("_most", "_level", "_left", "_weights", "_fill", "_free")


def segments(knots: DataFrame) -> DataFrame:
    """Knots (src, t, w: weight over 0 to 1, at least two a source) to one array of linear pieces a source, each with
    the integral before it (`a0`), and the integral of all (`area`)."""
    order = Window.partitionBy("src").orderBy("t")
    piece = knots.withColumn("t1", F.lead("t").over(order)).withColumn("w1", F.lead("w").over(order)).where("t1 is not null")
    piece = piece.withColumn("a", (F.col("w") + F.col("w1")) / 2 * (F.col("t1") - F.col("t")))
    piece = piece.withColumn("a0", F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("a"))
    return piece.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("a0", "t", "t1", "w", "w1"))).alias("pieces"), F.sum("a").alias("area"))


def inverse(pieces: Column, x: Column) -> Column:
    """The time at which the integral of a schedule reaches x."""

    def solve(p: Column) -> Column:
        y, slope = x - p["a0"], (p["w1"] - p["w"]) / (p["t1"] - p["t"])
        root = F.sqrt(F.greatest(p["w"] * p["w"] + 2 * slope * y, F.lit(0.0)))
        return p["t"] + F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (p["w"] + root))

    fits = F.filter(pieces, lambda p: p["a0"] <= x)
    return F.element_at(F.transform(F.slice(fits, -1, 1), solve), 1)


def default_knots(sources: DataFrame) -> DataFrame:
    """Sources of even rank fade from 1.5 to 0.5 times their mean weight, those of odd rank grow from 0.5 to 1.5."""
    fades = F.pmod(F.col("rank"), F.lit(2)) == 0
    first, last = F.when(fades, F.lit(1.5)).otherwise(F.lit(0.5)), F.when(fades, F.lit(0.5)).otherwise(F.lit(1.5))
    return sources.select("src", F.inline(F.array(F.struct(F.lit(0.0).alias("t"), first.alias("w")), F.struct(F.lit(1.0).alias("t"), last.alias("w")))))


def plan(rows: DataFrame, knots: DataFrame | None = None, sources: DataFrame | None = None, cap: float = CAP) -> DataFrame:
    """One row for each distinct (source, doc_id, size) of `rows`, with its number of `copies`, what its source has
    and gets (source_size, target), its schedule (pieces, area), and `before`, the words of its source that stand
    before it. `sources` (src, source_size, n_rows, rank, weight) overrides the weights, `knots` the schedules."""
    sources = with_targets(ranked_sources(rows) if sources is None else sources, cap)
    sources = sources.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))
    shapes = segments(default_knots(sources) if knots is None else knots).withColumnRenamed("src", "shape_src")
    sources = sources.join(shapes, F.col("src").eqNullSafe(F.col("shape_src")), "left")
    flat = F.array(F.struct(F.lit(0.0).alias("a0"), F.lit(0.0).alias("t"), F.lit(1.0).alias("t1"), F.lit(1.0).alias("w"), F.lit(1.0).alias("w1")))
    sources = sources.select("src", "source_size", "target", "share", F.coalesce("pieces", flat).alias("pieces"), F.coalesce("area", F.lit(1.0)).alias("area"))
    distinct = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    joined = distinct.join(sources, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    return running_total(joined, ["source"], ["doc_id", "size"], "words", "before", F.col("share"))


def passes(planned: DataFrame) -> DataFrame:
    """One row a copy: `taken` words, and `positions`, the training time of each pass over it, the last one partial
    if the target ends within it."""
    before = F.col("before") + F.col("copy") * F.col("size")
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - F.col("full") * F.col("source_size") - F.col("before")))
    n = F.when(F.col("size") > 0, F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    rows = planned.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("before", before).withColumn("goal", goal)
    rows = rows.withColumn("full", full).withColumn("part", part).withColumn("n_passes", n)
    numbers = F.when(F.col("n_passes") > 0, F.sequence(F.lit(0), F.col("n_passes") - 1)).otherwise(F.array().cast("array<int>"))
    at = F.transform(numbers, lambda i: inverse(F.col("pieces"), (F.col("before") + i * F.col("source_size")) / F.col("target") * F.col("area")))
    return rows.withColumn("taken", F.col("full") * F.col("size") + F.col("part")).withColumn("positions", at)


def sizes(docs: DataFrame) -> DataFrame:
    """source, doc_id and size of each row, written once: the plan reads them several times, the texts once."""
    return written(docs.select("source", "doc_id", n_words(F.col("text")).alias("size")), "sizes")


def mix(docs: DataFrame, knots: DataFrame | None = None) -> DataFrame:
    """What the mix takes of each document, range-sorted by the first training position (documents that it does not
    take come last)."""
    rows = sizes(docs)
    found = passes(plan(rows, knots)).withColumn("position", F.get("positions", F.lit(0)))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "position", "positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, knots: DataFrame | None = None) -> DataFrame:
    """The documents themselves in training order, one row for each pass; documents stay whole, so a partial pass
    counts if it takes over half of the document. Columns are those of `docs`. Times are found without the texts, which
    are shuffled twice: to their times, and into the order."""
    planned = plan(sizes(docs), knots)

    def keys(source: Column, doc_id: Column, size: Column) -> list[Column]:
        return [F.coalesce(source, F.lit("")).alias("k0"), source.isNull().alias("k1"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("k2"), doc_id.isNull().alias("k3"), size.alias("k4")]

    names = [f"k{i}" for i in range(5)]
    held = docs.select(F.struct("*").alias("doc"), *keys(F.col("source"), F.col("doc_id"), n_words(F.col("text"))))
    needed = ("size", "copies", "source_size", "target", "pieces", "area", "before")
    joined = held.join(planned.select(*keys(F.col("source"), F.col("doc_id"), F.col("size")), *needed), names)
    copy = (F.row_number().over(Window.partitionBy(*names).orderBy("k4")) - 1).cast("long")
    numbered = joined.withColumn("before", F.col("before") + copy * F.col("size")).withColumn("copies", F.lit(1).cast("long"))
    taken = passes(numbered).withColumn("whole", F.col("full") + F.when(F.col("part") * 2 > F.col("size"), 1).otherwise(0))
    each = taken.select("doc", "k2", F.explode(F.slice("positions", F.lit(1), F.col("whole").cast("int"))).alias("t"))
    return each.repartitionByRange("t", "k2").sortWithinPartitions("t", "k2").select("doc.*")
