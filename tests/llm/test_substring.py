"""Substring dedup against brute force over all windows; contexts of symbols; pieces of long texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelink.llm import substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def restated(rows, window):
    split = [(text or "").split() for _, text in rows]
    ids = [substring.LAST_ID if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, split):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for (doc_id, _), i, w in zip(rows, ids, split):
        keep = np.ones(len(w), bool)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                keep[k : k + window] = False
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((doc_id, len(w), int((~keep).sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def corpus(seed, n=120):
    """Texts of few words, with periods, shared passages, copies and near copies."""
    draw = random.Random(seed)
    passages = [[draw.choice("abcdefgh") * draw.randrange(1, 3) for _ in range(draw.randrange(40, 160))] for _ in range(6)]
    passages += [["la"] * 130, ["x", "y"] * 70, ["p", "q", "r", "p"] * 40]
    texts = []
    for _ in range(n):
        kind = draw.random()
        if kind < 0.2 and texts:
            words = list(draw.choice(texts))
        elif kind < 0.4 and texts and max(map(len, texts)):
            words = list(draw.choice(texts))
            for _ in range(3):
                words.insert(draw.randrange(len(words) + 1), f"new{draw.randrange(9)}")
        else:
            words = []
            for _ in range(draw.randrange(0, 5)):
                words += draw.choice(passages)[draw.choice([0, 0, 7]) :][: draw.choice([200, 60, 49, 50, 51])]
                words += [f"w{draw.randrange(50)}" for _ in range(draw.choice([0, 1, 30]))]
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_removed_words_are_those_of_brute_force(spark, seed):
    texts = corpus(seed)
    draw = random.Random(seed)
    ids = draw.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts)) + [(None, None), (None, texts[3]), (ids[5], texts[9]), (ids[7], texts[7]), (10**7, ""), (10**7 + 1, " \n\t ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("anchors", F.lit("clash")).withColumn("id", F.lit(1)).repartition(5)
    got = substring.report(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = restated(rows, substring.WINDOW)
    assert sum(r[2] > 0 for r in want) > 40
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_no_rows_and_a_hot_passage(spark):
    assert substring.report(spark.createDataFrame([], DOCS)).count() == 0
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"start{i} {passage} end{i} " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: r["n_removed"] for r in substring.report(df).collect()}
    assert got == {i: 80 * (i > 0) for i in range(300)}


@pytest.mark.parametrize("size", [64, 100, 1000])
def test_pieces_change_no_anchor(monkeypatch, size):
    draw = random.Random(size)
    texts = [t.encode().split() for t in corpus(size, 30)]
    texts.append([draw.choice([b"a", b"b"]) for _ in range(3000)])
    texts.append([b"%d" % draw.randrange(30) for _ in range(2000)] + [b"z"] * 700)

    def anchors():
        found = {}
        for words, places in substring.packed(texts):
            names = words.anchors()
            for (k, at, place), end in zip(places, words.walls[1:].tolist()):
                for i in range(place, end - substring.WINDOW + 1):
                    found[k, at + i - place] = names[i]
        return found

    whole = anchors()
    monkeypatch.setattr(substring, "PIECE", size)
    assert anchors() == whole and all(whole.values())
    assert len(whole) == sum(max(0, len(t) - substring.WINDOW + 1) for t in texts)


@pytest.mark.parametrize("seed", range(10))
def test_symbols_depend_on_their_context_only(seed):
    draw = random.Random(seed)
    letters = [b"%d" % i for i in range(draw.choice([2, 3, 40]))]
    text = [draw.choice(letters) for _ in range(300)] + [draw.choice(letters)] * draw.choice([1, 40])
    one, other = substring.Words([text]), substring.Words([[b"q"] + text[:150], text[150:] + [b"q", b"q"], text])
    for a, b in zip(one.rounds(8), other.rounds(8)):
        assert all(np.all(np.diff(x) >= 0) for x in (*a, *b))
        for start, low, high in zip(*a):
            # the third piece stands after two walls more and the two others
            at = 1 + 151 + 1 + len(text[150:]) + 2
            inside = low >= 1 and high <= len(text) + 1
            if inside:
                place = np.searchsorted(b[0], start + at)
                assert b[0][place] == start + at and (b[1][place], b[2][place]) == (low + at, high + at)
    ends = list(one.rounds(16))[-1][0]
    assert len(ends) < len(text) / 10
