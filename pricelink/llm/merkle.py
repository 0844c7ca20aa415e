"""Merkle manifest of a dataset: one tree a source, one tree over the sources, and a proof for every row.

A node is the SHA-256 (lowercase hex) of the concatenated digests of up to three nodes below it. The trees are built by a
nested-struct rollup: a row's rank in its source is written in base 3; its digits, from the last, are grouped away one
after the other, and each group becomes a struct of its digest and its children. This goes on within blocks of
3 ** DEPTH consecutive rows, so a nested struct stays small whatever the source's size, and all of a block's groupings
share one exchange. The roots of the blocks are the rows of the next tier (a billion rows have four tiers). To prove the
rows, each block is taken apart again: a transform at each level gives every child the digests of its siblings, an
explode gives it a row, so within a block nothing is joined; only a block as a whole meets the path above it.

A row's fields are doc_id, source, lang, n_chars and text, each as its number of UTF-8 bytes, a colon and the value, `-`
for null. Rows of a source ascend by doc_id, null ids last; rows with one id are ordered by their digests, and repeated
rows are leaves of their own. A null source is a source, the first one. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import ranked
from .common import written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
WAYS = 3
#: Levels of a tree that are nested in one row: a block has WAYS ** DEPTH rows at most.
DEPTH = 6
BLOCK = WAYS**DEPTH
POWERS = [WAYS**i for i in range(40)]


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row, with other values in place of some of its fields."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in POWERS]), lambda p: p < n))


def nested(nodes: DataFrame, group: list[str]) -> DataFrame:
    """One row a block of nodes (group, rank from 0, n: nodes of the group, h, item): group, block, n, levels, and `node`, a
    struct of the block's digest and its children, DEPTH deep. Where a group has fewer levels, the upper structs have one
    child and pass its digest on."""
    digits = [F.pmod(F.floor(F.col("rank") / F.lit(WAYS**i)), F.lit(WAYS)).cast("int").alias(f"d{i}") for i in range(DEPTH)]
    block = F.floor(F.col("rank") / F.lit(BLOCK)).cast("long").alias("block")
    levels = F.least(F.lit(DEPTH), height(F.col("n"))).alias("levels")
    rows = nodes.select(*group, block, "n", levels, *digits, F.struct("h", "item").alias("node")).repartition(*group, "block")
    for level in range(DEPTH):
        by = [*group, "block", "n", "levels", *[f"d{i}" for i in range(level + 1, DEPTH)]]
        rows = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "node"))).alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["h"]), ""), 256)
        h = F.when(F.col("levels") > level, joined).otherwise(F.get("kids", F.lit(0))["node"]["h"])
        rows = rows.select(*by, F.struct(h.alias("h"), F.col("kids")).alias("node"))
    return rows


def children(level: int) -> Column:
    """The children of `node`, each with its rank and the path from it upwards."""
    digests = F.transform("node.kids", lambda k: k["node"]["h"])

    def child(k: Column, i: Column) -> Column:
        before, after = F.array_join(F.slice(digests, F.lit(1), i), ""), F.array_join(F.slice(digests, i + 2, F.lit(WAYS)), "")
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        path = F.when(F.col("levels") > level, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        return F.struct(k["node"].alias("node"), (F.col("rank") * WAYS + k["d"]).alias("rank"), path.alias("path"))

    return F.transform("node.kids", child)


def taken_apart(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes of blocks (keep, block, levels, node, path: siblings above the block): keep, rank, item and path, the siblings
    (before, after) at each level from the node upwards."""
    rows = blocks.withColumn("rank", F.col("block"))
    for level in reversed(range(DEPTH)):
        rows = rows.select(*keep, "levels", F.inline(children(level)))
    return rows.select(*keep, "rank", "node.item", "path")


PATH = "array<struct<before: string, after: string>>"


def tiers(nodes: DataFrame, group: list[str]) -> list[DataFrame]:
    """Written tables of blocks, from the nodes' own to those of one block a group."""
    found = []
    while True:
        found.append(written(nested(nodes, group), "merkle"))
        most = found[-1].agg(F.max("block")).first()[0]
        if not most:
            return found
        nodes = found[-1].select(*group, F.col("block").alias("rank"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("n"), F.col("node.h").alias("h"), F.lit(0).alias("item"))


def proved(found: list[DataFrame], group: list[str], tops: DataFrame | None, carried: list[str]) -> DataFrame:
    """The nodes of the lowest tier with their paths. `tops` (group, path, and the `carried` columns) has what stands above
    the root of each group; without it there is one group and nothing above."""
    above = found[-1].select(*group, F.lit(0).cast("long").alias("rank"), F.col("node.h").alias("top"))
    if tops is None:
        above = above.withColumn("path", F.array().cast(PATH))
    else:
        above = meet(above, tops, group)
    for blocks in reversed(found):
        known = above.select(*group, F.col("rank").alias("block"), "top", "path", *carried)
        placed = meet(blocks, known, [*group, "block"])
        above = taken_apart(placed, [*group, "top", *carried])
    return above


def meet(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join by keys that may be null."""
    renamed = others.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def manifest(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path (siblings from the leaf to the root), and `claimed`, the digest that is to be
    proved: `forged` where it is given and not null, else the leaf."""
    leaf = leaf_digest()
    claimed = leaf if forged is None else F.coalesce(forged, leaf)
    leaves = written(docs.select("source", "doc_id", leaf.alias("h"), claimed.alias("claimed")), "leaves")
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("claimed")]
    numbered = ranked(leaves, ["source"], order, "place", "n").withColumn("rank", F.col("place") - 1)
    own = tiers(numbered.withColumn("item", F.struct("doc_id", F.col("h").alias("leaf"), "claimed")), ["source"])
    roots = ranked(own[-1].select("source", F.col("node.h").alias("h")), [], [F.col("source").asc_nulls_first()], "place", "n")
    over = tiers(roots.select((F.col("place") - 1).alias("rank"), "n", "h", F.struct("source").alias("item")), [])
    tops = proved(over, [], None, []).select(F.col("item.source").alias("source"), F.col("top").alias("root"), "path")
    rows = proved(own, ["source"], tops, ["root"])
    return rows.select("item.doc_id", "source", "item.leaf", F.col("top").alias("subroot"), "root", "path", "item.claimed")


def folded(claimed: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, claimed, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def checked(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root and verified of every row."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    found = manifest(docs, forged).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends() -> Column:
    """The digest of a tampered row: where 2 divides the CRC-32 of the id, the text has lost its line ends."""
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, leaf_digest(text=F.translate("text", "\n", "")))
