"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z lower-cased, runs of words (repeats included; a shorter text is one run), XXH64 with seed 42 of each
run; a bit is 1 if it is set in over half of the hashes. Further lanes of 64 bits, for a finer distance, come from the
same hashes, mixed. Texts without words have fingerprint 0. Each text is read whole, in bounded pieces.

Links: documents with equal fingerprints are joined first (a group of copies is one node, however large).

`clusters` is exact, for small limits: distinct fingerprints within `limit` bits of 64 are found by cutting the bits into
segments with radii r_i such that sum(r_i + 1) > limit, so a pair within the limit lies within r_i in some segment i.
Small Hamming balls are enumerated (each side half of the radius), matched by a join on segment and value, and the
complete distance decides within the join: a pair is kept once, in its first segment, so candidates are never written
out. Which segments serve a limit depends on the number of fingerprints (fewer, wider ones for more of them) and is exact
for each choice.

`near_clusters` is for large limits over several lanes (48 of 256 bits, a similarity of 0.8). It goes by the same index, over
the segments of all lanes (`indexed`): every pair within LIMIT bits in some lane is found at every size, so all within
4 * (LIMIT + 1) - 1 = 19 bits of 256 are, however their texts came to them. Pairs beyond that are links too, if the complete
distance allows, and the index finds those that come near enough in a segment. It cannot find all of them: complete for 48 bits,
it takes 516 rows a fingerprint and chance matches of 11 pairs in a hundred, or 6,532 rows and 2 in a hundred (computed).
So MinHash bands over the same hashes are searched as well (`across`): BANDS keys a document, each the least values of ROWS
permutations, at any size. Two texts share a band with a probability of 1 - (1 - s ** ROWS) ** BANDS, which is 0.997 at a
similarity s of 0.8 and does not depend on the number of texts. Bands count a repeated run once and fingerprints count it each
time, so texts that repeat a passage often and differ in the rest are found by the index only. The complete distance of the
fingerprints decides in both.

Dense groups: the members of each bucket (a band, or a lane's half) are first tied to its least member, each by its complete
distance, so the rows of a dense group grow with its size, not with its square; once it is one component, only pairs with other
components are compared.

Links become components by alternating large-star and small-star steps, every step a written table.

Null texts have fingerprint 0 and are linked like any other. Null ids count as larger than all others: a component
of null ids only has a null id. Repeated rows are given back as often as they come. An empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, left_out, row_hash, small_batches, written

LIMIT = 4
RUN = 4
SEED = 42
BLOCK = 1 << 15
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

def plans(limit: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Segment widths with their radii for a limit, for each number of segments whose radii stay at 2 or less; the
    sum of radius + 1 is over the limit by one in each. Wider segments get the larger radii."""
    found = []
    for n in range(2, 17):
        width, radius = divmod(64, n), divmod(limit + 1 - n, n)
        widths = tuple(width[0] + (i < width[1]) for i in range(n))
        radii = tuple(radius[0] + (i < radius[1]) for i in range(n))
        if 0 <= limit + 1 - n and max(radii) <= 2:
            found.append((widths, radii))
    if not found:
        raise ValueError(f"a limit of {limit} bits of 64 needs segments too narrow for exact search; use near_clusters")
    return found


#: Keys of a text, and least values in each of them.
BANDS, ROWS = 20, 6
#: A component with more nodes than this in a bucket of the index is not compared with itself there.
CROWD = 64
#: A row of that index has all lanes and is sorted, so it costs as much as this many comparisons (an estimate).
DEAR = 200.0
#: Hashes of a text that are permuted at once.
PERMUTED = 1 << 12


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves for lane 0, others made of them for the lanes after it."""
    if not lane:
        return hashes
    x = (hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def run_hashes(text: str | None, run: int) -> Iterator[tuple[np.ndarray, int]]:
    """The hashes of a text's runs in blocks, and how many there are of them; none for a text without words."""
    from xxhash import xxh64_intdigest

    found = b" ".join(WORDS.findall((text or "").encode().translate(LOWER)))
    if not found:
        return
    marks = np.flatnonzero(np.frombuffer(found, np.uint8) == 32)
    starts = np.concatenate(([0], marks + 1))
    ends = np.concatenate((marks, [len(found)]))
    n = max(1, len(starts) - run + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    view = memoryview(found)
    for at in range(0, n, BLOCK):
        yield np.array([xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], "<u8"), n


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of BANDS * ROWS permutations of the numbers below 2 ** 32."""
    draw = Random(SEED)
    return tuple(np.array([draw.getrandbits(32) | odd for _ in range(BANDS * ROWS)], np.uint32)[:, None] for odd in (1, 0))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over hashes."""
    factors, terms = permutations()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    return np.min([(factors * x[at : at + PERMUTED] + terms).min(axis=1) for at in range(0, len(x), PERMUTED)], axis=0)


def band_keys(least: np.ndarray) -> list[int]:
    """One number for each band of least values."""
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key ^ part, 1)
    return key.view(np.int64).tolist()


def fingerprint(text: str | None, run: int = RUN, lanes: int = 1, bands: bool = False) -> tuple[list[int], list[int]]:
    """The lanes of the fingerprint as signed 64-bit integers, and the keys of its bands if they are asked for."""
    counts, least, n = np.zeros((lanes, 64), np.int64), np.full(BANDS * ROWS, 2**32 - 1, np.uint32), 0
    for hashes, n in run_hashes(text, run):
        for lane in range(lanes):
            counts[lane] += np.unpackbits(mixed(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if bands:
            least = np.minimum(least, least_values(hashes))
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist(), band_keys(least) if bands else []


def fingerprints(text: Column, run: int = RUN, lanes: int = 1, bands: bool = False) -> Column:
    """The fingerprint's lanes and its bands as arrays."""

    @F.pandas_udf("struct<lanes: array<long>, bands: array<long>>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fingerprint(t, run, lanes, bands) for t in batch], columns=["lanes", "bands"])

    return each(text)


def flips(width: int, radius: int) -> list[int]:
    """All differences of at most `radius` bits in a segment."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def plan_for(n: int, limit: int, dear: float = 10.0) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The plan with the least work for n fingerprints: rows (written, so `dear` times a comparison) and comparisons."""

    def cost(plan) -> float:
        sides = [[sum(comb(w, i) for i in range(part + 1)) for part in (r - r // 2, r // 2)] for w, r in zip(*plan)]
        return dear * n * sum(a + b for a, b in sides) + float(n) ** 2 * sum(a * b / 2.0**w for (a, b), w in zip(sides, plan[0]))

    return min(plans(limit), key=cost)


def links(nodes: DataFrame, limit: int = LIMIT, plan=None) -> DataFrame:
    """Pairs u > v of nodes (id, fp) at `limit` bits or fewer in fp, each pair once."""
    widths, radii = plan or plan_for(nodes.count(), limit)
    lows = [sum(widths[:i]) for i in range(len(widths))]

    def part(fp: Column, i: int) -> Column:
        return F.shiftrightunsigned(fp, lows[i]).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))

    def around(i: int, ball: Column) -> Column:
        return F.transform(ball, lambda d: F.struct(F.lit(i).alias("seg"), part(F.col("fp"), i).bitwiseXOR(d).alias("value")))

    def side(radius_of) -> Column:
        rows = []
        for i, (width, radius) in enumerate(zip(widths, radii)):
            ball = F.array(*[F.lit(d).cast("long") for d in flips(width, radius_of(radius))])
            rows.append(around(i, ball))
        return F.inline(F.concat(*rows))

    probing = nodes.select(F.col("id").alias("u"), F.col("fp").alias("fu"), side(lambda r: r - r // 2)).withColumnsRenamed({"seg": "su", "value": "xu"})
    held = nodes.select(F.col("id").alias("v"), F.col("fp").alias("fv"), side(lambda r: r // 2)).withColumnsRenamed({"seg": "sv", "value": "xv"})
    bits = F.col("fu").bitwiseXOR(F.col("fv"))
    once = F.lit(True)
    for i, radius in enumerate(radii):
        change = part(bits, i)
        # the probing side moves by the lowest bit that differs, if it moves at all
        moved = change.bitwiseAND(-change) if radius else F.lit(0).cast("long")
        here = F.col("xu") == part(F.col("fu"), i).bitwiseXOR(moved)
        for j in range(i):
            here = here & (F.bit_count(part(bits, j)) > radii[j])
        once = once & ((F.col("su") != i) | here)
    near = (F.col("u") > F.col("v")) & (F.bit_count(bits) <= limit) & once
    return probing.join(held, (F.col("su") == F.col("sv")) & (F.col("xu") == F.col("xv")) & near).select("u", "v")


def apart(a: str, b: str) -> Column:
    """Bits that differ in all lanes of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def verified(pairs: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """The pairs (u, v) of nodes (id, lanes) that differ in at most `total` bits altogether."""
    one = pairs.join(nodes.select(F.col("id").alias("u"), F.col("lanes").alias("_lu")), "u")
    both = one.join(nodes.select(F.col("id").alias("v"), F.col("lanes").alias("_lv")), "v")
    return both.where(apart("_lu", "_lv") <= total).select("u", "v")


def ties(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v): each member of a bucket of nodes (id, bands) with the bucket's least member."""
    rows = nodes.select("id", F.explode("bands").alias("key"))
    least = rows.groupBy(F.col("key").alias("_key")).agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(least, F.col("key") == F.col("_key")).where("id > v").select(F.col("id").alias("u"), "v").distinct()


def halves(n_lanes: int) -> Column:
    """A key for each half of each lane of nodes (lanes)."""
    low = F.lit((1 << 32) - 1).cast("long")
    parts = [F.shiftrightunsigned(F.get("lanes", F.lit(k)), 32 * i).bitwiseAND(low) for k in range(n_lanes) for i in range(2)]
    return F.array(*[F.xxhash64(F.lit(i), part) for i, part in enumerate(parts)])


def ball_keys(n_lanes: int, widths: tuple[int, ...], radii: list[int]) -> Column:
    """Keys of nodes (lanes): for each segment of each lane its number and the values within its radius."""
    found = []
    for k in range(n_lanes):
        for i, (width, radius) in enumerate(zip(widths, radii)):
            part = F.shiftrightunsigned(F.get("lanes", F.lit(k)), sum(widths[:i])).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            number = (k * len(widths) + i) << 32
            found += [part.bitwiseXOR(F.lit(d | number).cast("long")) for d in flips(width, radius)]
    return F.array(*found)


def indexed(nodes: DataFrame, n_lanes: int, total: int, plan=None, crowd: int = CROWD) -> DataFrame:
    """Pairs (u > v) of components with nodes (id, lanes, comp), by the multi-index of `links` over the segments of all lanes:
    all that hold nodes within LIMIT bits (or the plan's limit) in some lane and within `total` bits in all, and those within
    `total` that come as near in a segment as its radius. In a bucket where a component has more than `crowd` nodes, the
    largest such component is compared with the others only. The complete distance decides within the join."""
    widths, radii = plan or plan_for(nodes.count(), LIMIT, DEAR)
    lanes = [F.get("lanes", F.lit(k)).alias(f"f{k}") for k in range(n_lanes)]
    held = nodes.select("comp", *lanes, F.explode(ball_keys(n_lanes, widths, [r // 2 for r in radii])).alias("key"))
    probing = nodes.select("comp", *lanes, F.explode(ball_keys(n_lanes, widths, [r - r // 2 for r in radii])).alias("key"))
    large = nodes.groupBy(F.col("comp").alias("_comp")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("_comp")
    crowds = held.select("comp", "key").join(large, F.col("comp") == F.col("_comp")).groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    mains = written(crowds.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("n", "comp"))["comp"].alias("main")), "crowds")

    def side(rows: DataFrame, name: str, rest: Column) -> DataFrame:
        marked = rows.join(mains, F.col("key") == F.col("_key"), "left").withColumn("rest", rest)
        return marked.select((F.col("key") * 2 + F.col("rest")).alias(f"k{name}"), F.col("comp").alias(f"c{name}"), *[F.col(f"f{k}").alias(f"{name}{k}") for k in range(n_lanes)])

    # the main component of a bucket meets the rest of it (odd keys), all others meet the whole bucket (even keys)
    us = side(probing, "u", F.coalesce((F.col("comp") == F.col("main")).cast("int"), F.lit(0)))
    vs = side(held, "v", F.explode(F.when(F.col("comp") != F.col("main"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    bits = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, n_lanes)), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))
    near = (F.col("cu") > F.col("cv")) & (bits <= total)
    return us.join(vs, (F.col("ku") == F.col("kv")) & near).select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()


def across(nodes: DataFrame, n_lanes: int, total: int) -> DataFrame:
    """Pairs (u > v) of components with nodes (id, lanes, bands, comp) that share a bucket and differ in `total` bits at most.
    In each bucket the rows of all components but its largest are compared with all others, so a component is never
    compared with itself, however much of the bucket it fills. Lanes are fetched for buckets of several components only;
    the complete distance decides within the join."""
    rows = nodes.select("id", "comp", F.explode("bands").alias("key"))
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    lanes = nodes.select(F.col("id").alias("_id"), *[F.get("lanes", F.lit(k)).alias(f"f{k}") for k in range(n_lanes)])
    marked = written(rows.join(several, F.col("key") == F.col("_key")).join(lanes, F.col("id") == F.col("_id")).drop("_key", "_id", "parts"), "buckets")
    small = marked.where("comp <> main").select(F.col("key").alias("ku"), F.col("id").alias("u"), F.col("comp").alias("cu"), *[F.col(f"f{k}").alias(f"u{k}") for k in range(n_lanes)])
    every = marked.select(F.col("key").alias("kv"), F.col("id").alias("v"), F.col("comp").alias("cv"), (F.col("comp") == F.col("main")).alias("mv"), *[F.col(f"f{k}").alias(f"v{k}") for k in range(n_lanes)])
    bits = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, n_lanes)), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))
    near = (F.col("cu") != F.col("cv")) & (F.col("mv") | (F.col("u") > F.col("v"))) & (bits <= total)
    return small.join(every, (F.col("ku") == F.col("kv")) & near).select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct()


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Large: each node's larger neighbours move to its least neighbour (or itself).
    Small: each node and its smaller neighbours move to the least of these."""
    if large:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")).withColumnRenamed("u", "node")
        moved = both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least.withColumnRenamed("u", "node"), F.col("u") == F.col("node")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes with an edge. Every step is written, so
    plans stay short and lost executors cost one step; only a count and a sum reach the driver."""
    edges = written(edges.distinct(), "links")

    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = seen(edges)
    while before[0]:
        last, edges = edges, written(star(star(edges, True), False), "stars")
        discard(last)
        after = seen(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def merged(nodes: DataFrame, pairs: DataFrame, comp: str = "id") -> DataFrame:
    """nodes with `comp`, the least `comp` of all that the pairs tie together."""
    roots = components(pairs)
    kept = [c for c in nodes.columns if c != "comp"]
    return written(nodes.join(roots, F.col(comp) == F.col("node"), "left").select(*kept, F.coalesce("root", comp).alias("comp")), "nodes")


def printed(docs: DataFrame, run: int, lanes: int, keep: dict[str, Column], bands: bool = False) -> tuple[DataFrame, DataFrame]:
    """Written tables: `keep` columns and lanes of every document; and nodes (id, fp, lanes, bands, least), one for each
    distinct fingerprint."""
    small_batches(docs.sparkSession)
    prints = written(docs.select(*[v.alias(k) for k, v in keep.items()], fingerprints(F.col("text"), run, lanes, bands).alias("_f")).select(*keep, "_f.lanes", "_f.bands"), "fingerprints")
    nodes = prints.groupBy("lanes").agg(F.min("doc_id").alias("least"), *([F.min("bands").alias("bands")] if bands else []))
    kept = ["lanes", *(["bands"] if bands else []), "least"]
    return prints.drop("bands"), written(nodes.select(F.monotonically_increasing_id().alias("id"), F.get("lanes", F.lit(0)).alias("fp"), *kept), "nodes")


def labelled(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """prints with component_id: the least doc_id of the component of their fingerprint; and comp, a number of it."""
    ids = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_print = nodes.select("comp", F.col("lanes").alias("_lanes")).join(ids, "comp").select("_lanes", "comp", "component_id")
    return prints.join(by_print, F.col("lanes") == F.col("_lanes")).drop("_lanes")


def clusters(docs: DataFrame, limit: int = LIMIT, run: int = RUN, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id (or the `keep` columns, doc_id among them), lanes and component_id of every document: all pairs within
    `limit` bits of 64 are linked, and no others."""
    prints, nodes = printed(docs, run, 1, keep or {"doc_id": F.col("doc_id")})
    return labelled(prints, merged(nodes, links(nodes, limit)))


def near_clusters(docs: DataFrame, total: int, run: int = 5, lanes: int = 4, keep: dict[str, Column] | None = None) -> DataFrame:
    """As `clusters`, for pairs within `total` bits of all lanes: no pair beyond is linked. Those within LIMIT bits in some lane
    all are, the others if they meet in the index or share a band."""
    prints, nodes = printed(docs, run, lanes, keep or {"doc_id": F.col("doc_id")}, True)
    buckets = nodes.withColumn("bands", F.concat("bands", halves(lanes)))
    tied = merged(nodes, verified(ties(buckets), nodes, total))
    pairs = indexed(tied, lanes, total).union(across(tied, lanes, total))
    return labelled(prints, merged(tied, pairs, "comp"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, total: int, run: int = 5, lanes: int = 4) -> DataFrame:
    """The documents without near-duplicates (see `near_clusters`): of each component the row with the smallest doc_id
    stays (one of them if it is repeated). Columns are those of `docs`. Texts are moved only for documents that share
    their id with a row that goes."""
    row = row_hash(docs)
    found = written(near_clusters(docs, total, run, lanes, {"doc_id": F.col("doc_id"), "row": row}), "components")
    each = found.groupBy("comp", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    least = each.groupBy(F.col("comp").alias("_c")).agg(F.min(order).alias("least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("row") == F.col("least.row"))
    marked = each.join(least, F.col("comp") == F.col("_c")).select("doc_id", "row", "n", stays.alias("stays"))
    touched = written(marked.where("not stays or n > 1").select(F.col("doc_id").alias("id"), F.col("row").alias("key"), "stays"), "touched")
    return left_out(docs, row, touched)
