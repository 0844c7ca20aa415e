"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both models are matched: bigrams interpolated with add-one unigrams, the same weights, and one shared vocabulary, which
is every word of the corpus and the end of a text. Words are runs of non-space characters, A-Z lower-cased. The
background is counted over all documents, the target over the documents whose id is a target id. A document is
scored by models without its own words (leave-one-out): its counts are taken off before its losses are, so it is not
predicted by itself, and a text that occurs twice in the corpus stands apart from one that occurs once. For a word b
after a, with the counts C left in a model of M tokens, and V words in the corpus,

    P(b | a) = PAIR_WEIGHT * C(a b) / C(a) + (1 - PAIR_WEIGHT) * (C(b) + 1) / (M + V + 1)

and the second fraction alone where C(a) is zero. A text's end is a token too (its start the context of its first
word), so C(a) is the count of the word a. Losses are rounded to millionths of a nat and added as integers, so results
do not depend on the order of rows. The score is the mean target loss minus the mean background loss over the tokens:
below zero, the target model predicts the text better.

Counts of all words and pairs of the corpus are gathered, none are hashed together (keys are 64 bits of two 64-bit word
hashes) and none pass through the driver. Documents are dealt into blocks of about BLOCK_BYTES of text; a block counts
its words and pairs, sends the counts to buckets of keys, and gets the corpus's totals of its own keys back, in order.
So a key has at most one count in a block and no hot word is a hot key; a block's texts are read whole, in pieces.
Shuffled are the texts and about nine bytes for each distinct pair of a block.

There are as many buckets as blocks, so beyond ONE_HOP blocks a block's counts would lie in rows of a few keys each. Then
blocks form teams, as many as the root of their number, and so do buckets: a block sends its counts to teams of buckets, a
team of blocks adds them up there and sends the sums on to buckets, and the totals come back in the same two steps. A block
has as many rows as there are teams, and no task of either step holds more than about a block's counts.

Null or empty texts have no words, and null losses and score. Several labels of a document count as their largest;
null ids and ids without a label are background only. Repeated rows count as often as they come; each is scored by the
others. Documents that come in an order that changes from one reading to the next must be written before. An empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import A_TO_Z, SPACES, may_meet, small_batches, written

PAIR_WEIGHT = 0.7
UNIT = 1e6
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
#: Up to so many blocks (64 GB of text), a row of a block and a bucket has about forty keys or more.
ONE_HOP = 1 << 14

LOWER = bytes.maketrans(A_TO_Z.encode(), A_TO_Z.lower().encode())
_spaces = frozenset(SPACES.encode())
#: The key under which the number of tokens is summed; word and pair keys are odd multiples away from meeting it.
TOTAL = np.uint64(0)
LOW = 0xFFFFFFFF


def pieces(text: str | None) -> Iterator[bytes]:
    """A text in runs of about PIECE_BYTES, cut where a word ends."""
    raw, done = (text or "").encode("utf-8", "surrogatepass"), 0
    while done < len(raw):
        end = len(raw)
        if end - done > PIECE_BYTES:
            end = next((e for e in range(done + PIECE_BYTES, len(raw)) if raw[e] in _spaces), len(raw))
        yield raw[done:end].translate(LOWER)
        done = end


class Block:
    """The tokens of some texts, and the counts of their words and pairs by key, for all texts and for the wanted
    ones. Word 0 is the start and the end of a text."""

    def __init__(self, texts: Iterable[str | None], wanted: np.ndarray):
        from xxhash import xxh64_intdigest

        ids: dict[bytes, int] = defaultdict(count().__next__)
        ids[b""]
        parts, self.sizes, self.wanted = [], np.zeros(len(wanted), np.int64), wanted
        for i, text in enumerate(texts):
            for words in map(bytes.split, pieces(text)):
                if words:
                    parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                    self.sizes[i] += len(words)
            if self.sizes[i]:
                parts.append(np.zeros(1, np.int64))
                self.sizes[i] += 1
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(wanted)), self.sizes)
        # a text ends with word 0, which so stands before the first word of the next one
        before = np.concatenate(([0], self.tokens[:-1]))[: len(self.tokens)]
        self.pairs, self.place, pair_all = np.unique(before << 32 | self.tokens, return_inverse=True, return_counts=True)
        chosen = wanted[self.owner]
        counts = [(np.bincount(self.tokens, minlength=len(ids)), pair_all), (np.bincount(self.tokens[chosen], minlength=len(ids)), np.bincount(self.place[chosen], minlength=len(self.pairs)))]
        hashes = np.fromiter((xxh64_intdigest(w) for w in ids), np.uint64, len(ids)) | np.uint64(1)
        keys = np.concatenate((hashes, pair_keys(hashes[self.pairs >> 32], hashes[self.pairs & LOW]), [TOTAL]))
        self.n_words = len(ids)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.background, self.target = (np.concatenate((w, p, [w.sum()]))[self.order] for w, p in counts)

    def losses(self, totals: dict[str, np.ndarray], vocabulary: int) -> dict[str, list]:
        """n_words and the sums of both losses (in units, integers) of each text, by the corpus's totals of `keys`."""
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(back))
        each, n = np.unique(self.owner << 32 | self.place, return_counts=True)
        words, own = np.unique(self.owner << 32 | self.tokens, return_counts=True)
        text, at = each >> 32, each & LOW
        a, b = self.pairs[at] >> 32, self.pairs[at] & LOW
        own_a, own_b = own[np.searchsorted(words, text << 32 | a)], own[np.searchsorted(words, text << 32 | b)]
        filled = np.flatnonzero(self.sizes)
        starts = np.searchsorted(text, filled)
        out = {"n_words": np.maximum(self.sizes - 1, 0).tolist()}
        for name in ("target", "background"):
            total = totals[name][back]
            off = np.ones(len(text), np.int64) if name == "background" else self.wanted[text].astype(np.int64)
            first, second = total[a] - off * own_a, total[b] - off * own_b
            alone = (second + 1) / (total[-1] - off * self.sizes[text] + vocabulary + 1).astype(np.float64)
            tied = (total[self.n_words + at] - off * n) / np.maximum(first, 1)
            p = np.where(first > 0, PAIR_WEIGHT * tied + (1 - PAIR_WEIGHT) * alone, alone)
            sums: list[int | None] = [None] * len(self.sizes)
            if len(filled):
                added = np.add.reduceat(np.rint(-np.log(p) * UNIT).astype(np.int64) * n, starts)
                for i, x in zip(filled, added.tolist()):
                    sums[i] = x
            out[f"{name}_loss"] = sums
        return out


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of two hashes, even (word keys are odd) and not TOTAL but by chance."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(31) | b >> np.uint64(33))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & ~np.uint64(1)


def packed(values: np.ndarray, level: int = 0) -> bytes:
    """Integers as planes of bytes, as many as the largest needs (their number comes first); with a level, compressed, as
    most counts are small."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return bytes([width]) + zlib.compress(planes, level)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : data[0]] = planes.T
    return whole.view("<u8").ravel().astype(np.int64)


COUNTS = ["keys", "target", "background"]


def rows_of(keys: np.ndarray, target: np.ndarray, background: np.ndarray, n: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """Counts of ascending keys in rows of one bucket (of n) each: the buckets, and COUNTS."""
    bucket = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = [[packed(x, 1) for x in np.split(values, cuts)] for values in (target, background)]
    # keys of a bucket are near each other, so their steps have fewer bytes
    parts.insert(0, [packed(np.diff(x, prepend=x[:1])) + x[0].tobytes() for x in np.split(keys, cuts)])
    return bucket[np.concatenate(([0], cuts))].astype(np.int64), parts


class Added:
    """Rows of counts with the same keys in part, and their sums by key."""

    def __init__(self, table: pa.Table):
        keys = [np.cumsum(unpacked(x[:-8]).view(np.uint64), dtype=np.uint64) + np.frombuffer(x[-8:], np.uint64) for x in table.column("keys").to_pylist()]
        self.keys, self.place = np.unique(np.concatenate(keys), return_inverse=True)
        self.cuts = np.cumsum([len(x) for x in keys])[:-1]
        self.own, self.sums = [], []
        for side in COUNTS[1:]:
            own = np.concatenate([unpacked(x) for x in table.column(side).to_pylist()])
            self.own.append(own)
            self.sums.append(np.zeros(len(self.keys), np.int64))
            np.add.at(self.sums[-1], self.place, own)

    def others(self, totals: list[np.ndarray]) -> list[list[bytes]]:
        """What the totals of the keys hold beyond each row's own: zeros for most, which shuffle in few bytes."""
        return [[packed(x, 1) for x in np.split(total[self.place] - own, self.cuts)] for total, own in zip(totals, self.own)]


def teams(n: int) -> int:
    """How many teams n blocks form: the root of n, rounded up; one team where one step is enough."""
    return 1 if n <= ONE_HOP else isqrt(n - 1) + 1


def dealt(docs: DataFrame, target: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _text, _row and whether the id is one of the target's (a table of one column, ids). Only rows that a Bloom
    filter of the target ids lets pass are joined to them."""
    ids = target.toDF("_wanted").where(F.col("_wanted").isNotNull()).distinct()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    sure, maybe = may_meet(rows, F.col("_id"), ids, F.col("_wanted"))
    joined = maybe.join(ids, F.col("_id") == F.col("_wanted"), "left")
    return sure.withColumn("_is", F.lit(False)).union(joined.select("_id", "_text", "_row", F.col("_wanted").isNotNull().alias("_is")))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, target_loss, background_loss and score of every document; `target`: a table of one column, the ids
    of the target documents."""
    small_batches(docs.sparkSession)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    n = max(1, -(-n_bytes // block_bytes))
    rows = dealt(docs, target, key, text).withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(n).cast("long")))

    def block_of(table: pa.Table) -> Block:
        return Block((x.as_py() for x in table.column("_text")), table.column("_is").to_numpy())

    m = teams(n)
    n_buckets, first = (n, n) if m == 1 else (m * m, m)

    def counted(table: pa.Table) -> pa.Table:
        block = block_of(table)
        names, parts = rows_of(block.keys, block.target, block.background, first)
        arrays = [pa.array([table.column("_block")[0].as_py()] * len(names), pa.int64()), pa.array(names), *[pa.array(x, pa.binary()) for x in parts]]
        return pa.Table.from_arrays(arrays, ["block", "bucket", *COUNTS])

    def summed(table: pa.Table) -> pa.Table:
        """What the other blocks have of each block's keys, and the number of words among the keys."""
        added = Added(table)
        n_words = int((added.keys & np.uint64(1)).sum())
        columns = [table.column("block").to_pylist() + [None], table.column("bucket").to_pylist() + [None], *[x + [None] for x in added.others(added.sums)], [None] * len(table) + [n_words]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["block", "bucket", "target", "background", "n_words"])

    def by_team(table: pa.Table) -> pa.Table:
        """The sums of a team of blocks for a team of buckets, by bucket; the team stands as their block."""
        added = Added(table)
        names, parts = rows_of(added.keys, *added.sums, n_buckets)
        return pa.Table.from_arrays([pa.array([table.column("team")[0].as_py()] * len(names), pa.int64()), pa.array(names), *[pa.array(x, pa.binary()) for x in parts]], ["block", "bucket", *COUNTS])

    def by_block(table: pa.Table, told: pa.Table) -> pa.Table:
        """What all other blocks have of the keys of each block of a team, from what the other teams have of the team's."""
        added, told = Added(table), told.sort_by("bucket")
        totals = [own + np.concatenate([unpacked(x) for x in told.column(side).to_pylist()]) for own, side in zip(added.sums, COUNTS[1:])]
        return pa.Table.from_arrays([table.column("block"), table.column("bucket"), *[pa.array(x, pa.binary()) for x in added.others(totals)]], ["block", "bucket", "target", "background"])

    def judged(table: pa.Table, sums: pa.Table) -> pa.Table:
        block, sums = block_of(table), sums.sort_by("bucket")
        totals = {side: own + np.concatenate([unpacked(x) for x in sums.column(side).to_pylist()]) for side, own in (("target", block.target), ("background", block.background))}
        found = block.losses(totals, sums.column("vocabulary")[0].as_py())
        return pa.Table.from_arrays([table.column("_id"), *[pa.array(x, pa.int64()) for x in found.values()]], ["_id", *found])

    counts = "block long, bucket long, keys binary, target binary, background binary"
    local = rows.groupBy("_block").applyInArrow(counted, counts)
    if m > 1:
        local = written(local, "counts").withColumn("team", F.pmod("block", F.lit(m).cast("long")))
    met = local if m == 1 else local.groupBy("team", "bucket").applyInArrow(by_team, counts)
    sums = met.groupBy("bucket").applyInArrow(summed, "block long, bucket long, target binary, background binary, n_words long")
    if m > 1:
        sums = written(sums, "sums")
    # the word 0 is no word of the vocabulary
    size = sums.agg((F.coalesce(F.sum("n_words"), F.lit(0)) - 1).alias("n")).scalar()
    told = sums.where(F.col("block").isNotNull())
    if m > 1:
        back = told.groupBy(F.col("block").alias("team"), F.expr(f"bucket div {m}").alias("coarse"))
        told = local.groupBy("team", "bucket").cogroup(back).applyInArrow(by_block, "block long, bucket long, target binary, background binary")
    told = told.withColumn("vocabulary", size)
    kind = rows.schema["_id"].dataType.simpleString()
    losses = rows.groupBy("_block").cogroup(told.groupBy("block")).applyInArrow(judged, f"_id {kind}, n_words long, target_loss long, background_loss long")
    means = [(F.col(c) / (F.lit(UNIT) * (F.col("n_words") + 1))).alias(c) for c in ("target_loss", "background_loss")]
    return losses.select(F.col("_id").alias(key), "n_words", *means).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of the documents with a label of quality 1."""
    return labels.groupBy("doc_id").agg(F.max("quality").alias("most")).where("most = 1").select("doc_id")
