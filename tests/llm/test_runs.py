"""Runs by suffix trees against brute force; the query on small tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricelink.llm import runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(words, least=runs.LEAST):
    """All maximal stretches with a smallest period, by comparing every pair of places."""
    found, n = set(), len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            piece = words[i : i + length]
            smallest = next(p for p in range(1, q + 1) if all(x == y for x, y in zip(piece, piece[p:])))
            if smallest == q and length >= max(least, 3 * q):
                found.add((i, length, q))
            i = j + 1
    return found


def drawn(seed):
    draw = random.Random(seed)
    words = []
    while len(words) < draw.choice([5, 60, 200, 400]):
        piece = [draw.choice([b"a", b"b", b"c", b"dd"][: draw.choice([2, 4])]) for _ in range(draw.choice([1, 1, 2, 3, 7, 20]))]
        words += piece * draw.choice([1, 1, 2, 3, 9, 30])
        words += [b"%d" % draw.randrange(10**6) for _ in range(draw.choice([0, 0, 1, 12]))]
    return words


@pytest.mark.parametrize("seed", range(150))
def test_runs_are_those_of_brute_force(seed):
    words = drawn(seed)
    got = runs.runs_of(words)
    assert set(got) == brute(words) and len(set(got)) == len(got) and got == sorted(got, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_trees_give_suffix_order_and_extensions(seed):
    draw = random.Random(seed)
    numbers = [draw.randrange(1, draw.choice([2, 3, 9])+1) for _ in range(draw.randrange(1, 80))]
    tree, n = runs.SuffixTree(numbers, True), len(numbers)
    assert sorted(range(n + 1), key=lambda i: numbers[i:]) == sorted(range(n + 1), key=lambda i: tree.rank[i])
    assert sorted(range(n + 1), key=lambda i: [-x for x in numbers[i:]]) == sorted(range(n + 1), key=lambda i: tree.other[i])
    import numpy as np

    i, j = (x.ravel() for x in np.meshgrid(range(n + 1), range(n + 1)))
    i, j = i[i != j], j[i != j]
    want = [next((k for k in range(n) if max(a, b) + k >= n or numbers[a + k] != numbers[b + k]), n) for a, b in zip(i, j)]
    assert tree.lce(i, j).tolist() == want


def restated(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    keep = [not any(s + q <= i < s + length for s, length, q in found) for i in range(n)]
    best = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha(b"".join(b"%d,%d,%d\n" % r for r in found)), sha(b" ".join(w for w, k in zip(words, keep) if k)))


def test_query_on_small_tables(spark):
    texts = [None, "", " \n\t", "a", "a " * 24, "a " * 23, "x y z " * 20 + "end", "é  b " * 30, "tail " + "p q\n" * 500] + [b" ".join(drawn(s)).decode() for s in range(60)]
    ids = list(range(len(texts))) + [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    texts += [" ".join(f"w{(i * 7 + k * k) % 97}" for k in range(20 + 9 * (i % 40))) for i in ids[len(texts):]]
    rows = [(i, t) for i, t in zip(ids, texts)] + [(7, "a " * 40), (7, "a " * 40), (None, "b c " * 20)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1))
    got = runs.report(runs.with_planted_runs(df))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((restated(i, t) for i, t in rows), key=key)
    assert runs.report(runs.with_planted_runs(df.limit(0))).count() == 0


def test_long_text_and_columns(spark):
    text = "head " + "one two three " * 20_000 + " ".join(f"n{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text, "old")], "doc_id long, text string, collapsed string")
    out = runs.with_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    row = out.first()
    assert [tuple(r) for r in row["runs"]] == [(1, 60_000, 3)] and len(row["collapsed"].split()) == 60_004
