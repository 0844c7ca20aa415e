"""Substring dedup by recompression: words that a document shares with an earlier one in stretches of WINDOW or more.

Recompression names a text's runs, then its pairs, round by round: equal neighbours become one symbol, then a symbol whose
coin is 0 takes in a right neighbour whose coin is 1. A name is a hash of the names that it is made of, and so is a coin, so
all tasks give equal parts equal names: the naming is global, and a round needs no exchange. Equal substrings are parsed
alike but for what touches their ends. How much that is, is known: with each symbol goes its context, the words that it
depends on, and two places with equal contexts have the same symbol there.

Spark's rounds go from short names to long ones and back to words:

1. Anchors. Of the symbols of LOCAL rounds whose context lies in a window, the one with the least name of its context is the
   window's anchor (windows without such a symbol, as within long runs, take it from the round before, down to the words
   themselves). Equal windows have equal anchors, so a window whose anchor occurs in one text only is not repeated. Equal
   texts are taken as one before that: they have the same last symbol.
2. Blocks. Where anchors are shared, the text is cut at the symbols of LONG rounds. A block and the WINDOW - 1 words after it
   have one name of 128 bits; if a document with a smaller id has it too, all windows that start in the block are repeated.
   Of a group of copies only the first one's blocks stay open.
3. Windows of open blocks, each with its name of 128 bits and the least id that has it. A window in a closed block is also one
   of the open block of the same name, so the least id is never missed.

Long texts are cut into pieces that overlap by WINDOW - 1 words; as anchors depend on a window's words only, this changes
nothing. Names of 64 bits only decide what is looked at; those that decide what is removed have 128 bits.

A null or empty text has no words. Null ids are larger than all others. Rows that share an id are one document's and do not
remove words from each other; repeated rows are given back as often as they come. An empty table gives an empty table, and
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import may_meet, small_batches, written

WINDOW = 50
LOCAL, LONG = 4, 16
#: Words of a text that are parsed at once.
PIECE = 1 << 17
LAST_ID = (1 << 63) - 1

FACTOR = 0x9E3779B97F4A7C15
ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name of two names, in this order."""
    x = a * np.uint64(ODD[0]) + (b ^ (b >> np.uint64(31))) * np.uint64(ODD[1])
    x ^= x >> np.uint64(29)
    x *= np.uint64(ODD[2])
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers from 0 to n, and their inverses modulo 2 ** 64."""
    out = []
    for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


class Words:
    """Pieces of texts in a row, with a wall before, between and after them."""

    def __init__(self, pieces: list[list[bytes]]):
        from xxhash import xxh3_128_digest

        names: dict[bytes | None, int] = {None: 0}
        flat: list[bytes | None] = []
        for p in pieces:
            flat.append(None)
            flat += p
        flat.append(None)
        self.n = len(flat)
        self.ids = np.fromiter((names.setdefault(w, len(names)) for w in flat), np.int64, self.n)
        del names[None]
        hashes = np.zeros((len(names) + 1, 2), np.uint64)
        hashes[1:] = np.frombuffer(b"".join(map(xxh3_128_digest, names)), "<u8").reshape(-1, 2)
        self.names = [np.ascontiguousarray(hashes[:, k][self.ids]) for k in (0, 1)]
        self.walls = np.flatnonzero(self.ids == 0)
        room = np.append(np.repeat(self.walls[1:], np.diff(self.walls)), self.n - 1) - np.arange(self.n)
        self.starts = (room >= WINDOW) & (self.ids != 0)
        size = 1 << (self.n - 1).bit_length()
        up, self.down = (x[: self.n + 1] for x in powers(size))
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1]))) for h in self.names]

    def named(self, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
        """A name of the words from start to end, a polynomial of theirs, whose half is 0 or 1."""
        s = self.sums[half]
        return mixed((s[end] - s[start]) * self.down[start], (end - start).astype(np.uint64))

    def rounds(self, number: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(start, context start, context end) of the symbols, in order, before the first round and after each."""
        ids, start = self.ids, np.arange(self.n)
        end, low, high, name, wall = start + 1, start, start + 1, self.names[0], ids == 0
        yield start, low, high
        for r in range(number):
            same = (name[1:] == name[:-1]) & ~wall[1:]
            if same.any():
                first = np.flatnonzero(np.concatenate(([True], ~same)))
                last = np.append(first[1:], len(name)) - 1
                many, name = last > first, name[first]
                name[many] = mixed(name[many], (last - first + 1)[many].astype(np.uint64))
                start, end, low, high, wall = start[first], end[last], low[first], high[last], wall[first]
            # that a neighbour differs shows in the word next to the symbol, or else in all of its context
            before = np.where(ids[start - 1] != ids[end - 1], start - 1, np.roll(low, 1))
            after = np.where(ids[np.minimum(end, self.n - 1)] != ids[start], end + 1, np.roll(high, -1))
            low, high = np.minimum(low, before), np.maximum(high, after)
            coin = (name * np.uint64((ODD[r % 3] + 2 * r * FACTOR) & LAST_ID * 2 + 1 | 1) >> np.uint64(63)).astype(np.int8)
            coin[wall] = 2
            pair = (coin[:-1] == 0) & (coin[1:] == 1)
            left, right = np.append(pair, False), np.concatenate(([False], pair))
            low, high = np.where((coin == 1) & ~right, np.minimum(low, np.roll(low, 1)), low), np.where((coin == 0) & ~left, np.maximum(high, np.roll(high, -1)), high)
            kept = np.flatnonzero(~right)
            joined = kept[left[kept]]
            new = name.copy()
            new[joined] = mixed(name[joined], name[joined + 1])
            end, high = end.copy(), high.copy()
            end[joined], high[joined] = end[joined + 1], high[joined + 1]
            name, start, end, low, high, wall = new[kept], start[kept], end[kept], low[kept], high[kept], wall[kept]
            yield start, low, high

    def anchors(self) -> np.ndarray:
        """The name of the anchor of each window, by its start; zero where no window starts."""
        found, open_ = np.zeros(self.n, np.uint64), self.starts.copy()
        for _, low, high in reversed(list(self.rounds(LOCAL))):
            if not open_.any():
                break
            # contexts start and end in the order of their symbols, so those within a window are a range
            at = np.flatnonzero(open_)
            low, high = np.clip(low, 0, self.n), np.clip(high, 0, self.n)
            a = np.concatenate(([0], np.cumsum(np.bincount(low, minlength=self.n + 1))))[at]
            b = np.cumsum(np.bincount(high, minlength=self.n + 1))[at + WINDOW]
            some = b > a
            at, a, b = at[some], a[some], b[some]
            if not len(at):
                continue
            table = [self.named(low, high, 0)]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in range(int(level.max())):
                t = table[-1]
                table.append(np.minimum(t[: -(1 << k)], t[1 << k :]))
            for k, t in enumerate(table):
                here = level == k
                found[at[here]] = np.minimum(t[a[here]], t[b[here] - (1 << k)])
            open_[at] = False
        return found

    def cuts(self) -> np.ndarray:
        """The starts of the symbols of LONG rounds."""
        *_, (start, _, _) = self.rounds(LONG)
        return start


def packed(texts: list[list[bytes]]) -> Iterator[tuple[Words, list[tuple[int, int, int]]]]:
    """Words of about PIECE words, with (number of the text, its word, place among the Words) of each piece."""
    pieces, places, size = [], [], 0
    for k, words in enumerate(texts):
        for at in range(0, max(1, len(words) - WINDOW + 1), PIECE):
            piece = words[at : at + PIECE + WINDOW - 1]
            places.append((k, at, size + 1))
            pieces.append(piece)
            size += len(piece) + 1
            if size >= PIECE:
                yield Words(pieces), places
                pieces, places, size = [], [], 0
    if pieces:
        yield Words(pieces), places


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def parsed(text: Column) -> Column:
    """n_words, sha (of the words joined by one space) and the distinct anchors of a text's windows."""

    @F.pandas_udf("struct<n_words: long, sha: binary, anchors: array<long>>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [split(t) for t in batch]
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for words, places in packed(texts):
                names = words.anchors()
                for (k, _, place), end in zip(places, words.walls[1:].tolist()):
                    own = names[place : max(place, end - WINDOW + 1)]
                    if len(own):
                        found[k].append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            anchors = [np.unique(np.concatenate(x)).view(np.int64) if x else np.array([], np.int64) for x in found]
            yield pd.DataFrame({"n_words": [len(t) for t in texts], "sha": [digest(t) for t in texts], "anchors": anchors})

    return each(text)


BLOCKS = "array<struct<at: int, n: int, h1: long, h2: long, words: binary>>"


def blocks(text: Column, anchors: Column, sha: Column) -> Column:
    """Blocks of the windows whose anchor is one of `anchors`: the first start, the number of starts, the name, and the words
    of the windows. None for a text whose words are not those of `sha`."""

    @F.pandas_udf(BLOCKS)
    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, shared, shas in batches:
            texts = [split(t) for t in batch]
            texts = [t if digest(t) == s else [] for t, s in zip(texts, shas)]
            every = np.unique(np.concatenate([np.asarray(x, np.int64) for x in shared])).view(np.uint64) if len(shared) else np.array([], np.uint64)
            found: list[list[dict]] = [[] for _ in texts]
            for words, places in packed(texts):
                open_ = words.starts & np.isin(words.anchors(), every)
                cut = np.zeros(words.n, bool)
                cut[words.cuts()] = True
                edge = np.diff(np.concatenate(([False], open_)).astype(np.int8)) == 1
                firsts = np.flatnonzero(open_ & (edge | cut))
                ends = np.flatnonzero(open_ & ~np.append(open_[1:] & ~(edge | cut)[1:], False)) + 1
                h1, h2 = (words.named(firsts, ends + WINDOW - 1, k).view(np.int64) for k in (0, 1))
                owner = np.searchsorted([p for _, _, p in places], firsts, "right") - 1
                for i, a, b, x, y in zip(owner.tolist(), firsts.tolist(), ends.tolist(), h1.tolist(), h2.tolist()):
                    k, at, place = places[i]
                    at += a - place
                    found[k].append({"at": at, "n": b - a, "h1": x, "h2": y, "words": b" ".join(texts[k][at : at + b - a + WINDOW - 1])})
            yield pd.Series(found, dtype=object)

    return each(text, anchors, sha)


def window_names(words: Column) -> Column:
    """The two halves of the names of all windows of a block's words."""

    @F.pandas_udf("struct<h1: array<long>, h2: array<long>>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [w.split(b" ") for w in batch]
            found: list[list] = [[[], []] for _ in texts]
            for part, places in packed(texts):
                for (k, _, place), end in zip(places, part.walls[1:].tolist()):
                    starts = np.arange(place, max(place, end - WINDOW + 1))
                    for half in (0, 1):
                        found[k][half].append(part.named(starts, starts + WINDOW, half).view(np.int64))
            yield pd.DataFrame({f"h{i + 1}": [np.concatenate(x[i]) for x in found] for i in (0, 1)})

    return each(words)


def without_spans(text: Column, spans: Column, sha: Column) -> Column:
    """n_removed and the kept words (joined by one space) of a text without the WINDOW words of all starts of `spans` (at, n);
    null for a text whose words are not those of `sha`."""

    @F.pandas_udf("struct<n_removed: long, kept: string>")
    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, starts, shas in batches:
            rows = []
            for t, spans, s in zip(batch, starts, shas):
                words = split(t)
                if digest(words) != s:
                    rows.append((None, None))
                    continue
                keep = np.ones(len(words), bool)
                for span in spans:
                    keep[span["at"] : span["at"] + span["n"] + WINDOW - 1] = False
                kept = np.flatnonzero(keep).tolist()
                rows.append((len(words) - len(kept), b" ".join([words[i] for i in kept]).decode()))
            yield pd.DataFrame({"n_removed": pd.array([r[0] for r in rows], "Int64"), "kept": [r[1] for r in rows]})

    return each(text, spans, sha)


def identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")


def repeated(rows: DataFrame, parsed_rows: DataFrame) -> DataFrame:
    """id, sha and spans (at, n) of the starts of windows that also start in a document with a smaller id, for texts that no
    smaller id has as a whole. `rows`: identified documents; `parsed_rows`: a written table with id, n_words, sha, anchors."""
    long = parsed_rows.where(F.col("n_words") >= WINDOW)
    least = long.groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("least"))
    firsts = long.join(least, F.col("sha") == F.col("_sha")).where("id = least")
    each = written(firsts.select("id", "sha", F.xxhash64("sha").alias("row"), F.explode("anchors").alias("anchor")), "anchors")
    shared = each.groupBy(F.col("anchor").alias("_anchor")).agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("_anchor")
    suspects = written(each.join(shared, F.col("anchor") == F.col("_anchor"), "left_semi").groupBy("id", "sha").agg(F.collect_set("anchor").alias("anchors")), "suspects")
    maybe = may_meet(rows, F.col("id"), suspects, F.col("id"))[1].join(suspects.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
    cut = written(maybe.select("id", "sha", F.inline(blocks(F.col("text"), F.col("anchors"), F.col("sha")))), "blocks")
    first = cut.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("n").alias("_n")).agg(F.min("id").alias("least"))
    judged = written(cut.join(first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n"))).select("id", "sha", "at", "n", (F.col("id") > F.col("least")).alias("closed"), F.when(F.col("id") == F.col("least"), F.col("words")).alias("words")), "judged")
    open_ = judged.where("not closed").select("id", "sha", "at", window_names(F.col("words")).alias("w"))
    windows = written(open_.select("id", "sha", "at", F.posexplode(F.arrays_zip("w.h1", "w.h2")).alias("k", "h")).select("id", "sha", (F.col("at") + F.col("k")).alias("at"), "h.h1", "h.h2"), "windows")
    early = windows.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    late = windows.join(early, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where("id > least")
    spans = judged.where("closed").select("id", "sha", "at", "n").union(late.select("id", "sha", "at", F.lit(1).alias("n")))
    return spans.groupBy("id", "sha").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def deduped(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and `kept`, what is left of a text that loses some of its words but
    not all (null for the others, which are left as they are or lose all)."""
    small_batches(docs.sparkSession)
    rows = identified(docs)
    table = written(rows.select("doc_id", "id", parsed(F.col("text")).alias("p")).select("doc_id", "id", "p.n_words", "p.sha", "p.anchors"), "parsed")
    spans = written(repeated(rows, table), "spans")
    touched = spans.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "spans")
    maybe = may_meet(rows, F.col("id"), spans, F.col("id"))[1].join(touched, F.col("id") == F.col("_id"))
    cut = maybe.select("doc_id", without_spans(F.col("text"), F.col("spans"), F.col("_sha")).alias("c"), F.col("_sha").alias("sha")).where("c.n_removed is not null")
    n_kept = F.when(F.col("c.kept") == "", F.lit(0)).otherwise(F.size(F.split("c.kept", " "))).cast("long")
    some = cut.select("doc_id", (n_kept + F.col("c.n_removed")).alias("n_words"), "c.n_removed", F.sha2("c.kept", 256).alias("kept_sha256"), "c.kept")
    others = table.drop("anchors").join(touched, (F.col("id") == F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti")
    least = table.where(F.col("n_words") >= WINDOW).groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("least"))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    whole = others.join(least, F.col("sha") == F.col("_sha"), "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return some.unionByName(whole)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return deduped(docs).drop("kept")
