"""Periodic runs of words: maximal stretches of three or more periods, found by suffix trees.

A run is a stretch of consecutive words with smallest period q and a length of max(LEAST, 3 * q) or more, which no word next
to it extends with that period. Runs come from Lyndon roots: for both orders of the words, the longest Lyndon word at each
place is the root of a candidate, and it is extended to the right by the longest common extension (LCE) of its start and its
end, and to the left by that of the reversed words. An LCE is the depth of the lowest common ancestor of two leaves of
Ukkonen's suffix tree; the Euler tour of the tree, kept as the least depth between two leaves, answers it in constant time
by a sparse table of minima. Every run has such a root, so none is lost.

Trees are made for the stretches of a text that can hold a run, and no others. That bound is exact: in a run of period q,
each window of WINDOW words that starts after the first q words has an equal one at most q words before it, so a run leaves a
stretch of m consecutive repeated windows with m >= length - q - WINDOW + 1 and so q <= (m + WINDOW - 1) / 2; a window whose
last equal one is further away belongs to no run. Stretches that overlap are taken as one. Windows go by a hash, where a
collision can only add a stretch. A tree takes about half a kilobyte a word of a stretch; a stretch is within one text.

A null text has no words and no runs. Words are those of common.WORD, compared byte by byte. Rows are read one by one, so
repeated rows, ties and an empty table need no rule; other columns stay as they are, but for those that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches, text_or_empty

LEAST = 24
#: Words of a window, fewer than LEAST * 2 / 3, so that every run holds a repeated one.
WINDOW = 8
FACTOR = 0x9E3779B97F4A7C15


class SuffixTree:
    """Ukkonen's suffix tree of numbers over 0. `rank[i]` is the place of the suffix from i among all, in the order of the
    numbers (`other[i]`: in the reversed order), where what ends comes first; `lce` is the longest common extension."""

    def __init__(self, numbers: list[int], both_orders: bool):
        self.text = [*numbers, 0]
        self.sigma = max(self.text) + 1
        self.build()
        self.tour(both_orders)

    def build(self) -> None:
        text, sigma, end = self.text, self.sigma, len(self.text)
        first, last, link, child = [0], [0], [0], {}
        suffix = {}
        node = at = length = open_ = 0
        for i, symbol in enumerate(text):
            open_ += 1
            unlinked = 0
            while open_:
                if not length:
                    at = i
                key = node * sigma + text[at]
                below = child.get(key)
                if below is None:
                    suffix[len(first)] = len(suffix)
                    child[key] = len(first)
                    first.append(i)
                    last.append(end)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    start = first[below]
                    edge = min(last[below], i + 1) - start
                    if length >= edge:
                        at, length, node = at + edge, length - edge, below
                        continue
                    if text[start + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(first)
                    first += [start, i]
                    last += [start + length, end]
                    link += [0, 0]
                    suffix[middle + 1] = len(suffix)
                    first[below] = start + length
                    child[key] = middle
                    child[middle * sigma + symbol] = middle + 1
                    child[middle * sigma + text[start + length]] = below
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length, at = length - 1, i - open_ + 1
        self.first, self.last, self.child, self.suffix = first, last, child, suffix

    def tour(self, both_orders: bool) -> None:
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        below = np.fromiter(self.child.values(), np.int64, len(self.child))
        parent, symbol = np.divmod(keys, self.sigma)
        self.rank, depths = self.walk(parent, below, np.argsort(keys))
        self.tables = [np.array(depths, np.int32)]
        while 2 * (step := 1 << len(self.tables) - 1) <= len(depths):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-step], t[step:]))
        if both_orders:
            reverse = np.where(symbol > 0, self.sigma - symbol, 0)
            self.other, _ = self.walk(parent, below, np.argsort(parent * self.sigma + reverse))
        del self.child, self.first, self.last, self.suffix

    def walk(self, parent: np.ndarray, below: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The leaves in the order of an Euler tour, as ranks of the suffixes, and the least depth before each leaf."""
        starts = np.searchsorted(parent[order], np.arange(len(self.first) + 1)).tolist()
        kids = below[order].tolist()
        first, last, suffix = self.first, self.last, self.suffix
        leaves, depths, far = [], [], len(self.text)
        stack, low = [(k, 0) for k in kids[: starts[1]][::-1]], far
        while stack:
            node, depth = stack.pop()
            if depth < low:
                low = depth
            if node in suffix:
                leaves.append(suffix[node])
                depths.append(low)
                low = far
            else:
                depth += last[node] - first[node]
                stack += [(k, depth) for k in kids[starts[node] : starts[node + 1]][::-1]]
        rank = np.empty(len(leaves), np.int64)
        rank[leaves] = np.arange(len(leaves))
        return rank, depths

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths that the suffixes from i and from j (another one each) have in common."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            here = level == k
            t = self.tables[k]
            out[here] = np.minimum(t[low[here]], t[high[here] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place after each with a smaller rank; the last place has the smallest one."""
    ranks = rank.tolist()
    stack, found = [len(ranks) - 1], [0] * (len(ranks) - 1)
    for i in range(len(ranks) - 2, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        found[i] = stack[-1]
        stack.append(i)
    return np.array(found, np.int64)


def runs_within(numbers: list[int], least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbers over 0."""
    n = len(numbers)
    if n < least:
        return set()
    forth, back = SuffixTree(numbers, True), SuffixTree(numbers[::-1], False)
    found = set()
    for rank in (forth.rank, forth.other):
        start = np.arange(n)
        end = next_smaller(rank)
        root = end - start <= n // 3
        start, end = start[root], end[root]
        right = forth.lce(start, end)
        left = back.lce(n - start, n - end)
        period, length = end - start, left + (end - start) + right
        kept = length >= np.maximum(least, 3 * period)
        found.update(zip((start - left)[kept].tolist(), length[kept].tolist(), period[kept].tolist()))
    return found


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Where runs can be: (start, end) of stretches that do not overlap and hold every run whole."""
    n = len(words) - WINDOW + 1
    if n < LEAST - WINDOW + 1:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(FACTOR) + hashes[k : k + n]
    windows ^= windows >> np.uint64(32)
    order = np.argsort(windows, kind="stable")
    same = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    if not len(same):
        return []
    gap = np.full(n, 2 * n)
    gap[order[same + 1]] = order[same + 1] - order[same]
    open_ = gap < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        most = (ends - starts + WINDOW - 1) // 2
        kept = open_ & (gap <= np.repeat(most, ends - starts)[np.cumsum(open_) - 1])
        if kept.sum() == open_.sum():
            break
        open_ = kept
        if not open_.any():
            return []
    out: list[tuple[int, int]] = []
    for a, b, q in zip(starts.tolist(), ends.tolist(), most.tolist()):
        # fewer windows than this are no run of LEAST words
        if b - a >= LEAST - LEAST // 3 - WINDOW + 1:
            a, b = max(0, a - q), b + WINDOW - 1
            while out and out[-1][1] > a:
                a = min(a, out.pop()[0])
            out.append((a, b))
    return out


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start, then period."""
    found = []
    for a, b in stretches(words):
        names: dict[bytes, int] = {}
        numbers = [names.setdefault(w, len(names) + 1) for w in words[a:b]]
        found += [(a + start, length, period) for start, length, period in runs_within(numbers)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that repeat within a run, joined by one space."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


FOUND = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def runs(text: Column) -> Column:
    """A struct of a text's runs, by start, then period, and the text `collapsed`: what repeats within a run is left out, and
    the words are joined by one space."""

    @F.pandas_udf(FOUND)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                words = t.encode().split() if t else []
                found = runs_of(words)
                rows.append(([{"start": a, "length": n, "period": q} for a, n, q in found], collapsed(words, found).decode()))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    return each(text)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `runs` and `collapsed`, in place of columns of these names. One pass over the rows, no shuffle."""
    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    return docs.select(*rest, runs(F.col(f"`{text}`")).alias("_found")).select(*rest, "_found.runs", "_found.collapsed")


def strongest(found: Column) -> Column:
    """The run of the greatest length / period, compared as fractions; of equal ones the first."""
    none = F.get(found, F.lit(0))
    return F.aggregate(found, none, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text (by the CRC-32 h of its id) repeats a piece of itself: with g = h / 10 and n
    words, words from a = g % n on are those of a period of 1 + (n - a) / (3 + g % 8) words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(text_or_empty(F.col("text")), F.lit(WORD), F.lit(0))
    n = F.size("_w").cast("long")
    g = F.floor(h / 10).cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1).cast("long")))
    p = F.floor((n - F.col("_a")) / (3 + F.pmod(g, F.lit(8)))).cast("long") + 1
    rows = docs.select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("_w"))
    rows = rows.withColumn("_a", F.when(n > 0, a)).withColumn("_p", p)
    places = F.sequence(F.lit(0).cast("long"), n - 1)
    moved = F.transform(places, lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (null where there is none), and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = with_runs(docs.select("doc_id", "text")).select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
