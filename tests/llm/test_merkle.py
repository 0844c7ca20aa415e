"""The Merkle manifest against a restatement in plain Python, over one and several tiers of blocks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricelink.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, path of each node: siblings before and after at each level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def restated(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        own[s] = tree([leaf(r) for r in by[s]])
    root, above = tree([own[s][0] for s in sources])
    out = []
    for s, over in zip(sources, above):
        for r, path in zip(by[s], own[s][1]):
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if forged else leaf(r)
            for before, after in path + over:
                h = sha(before, h, after)
            proof = sha(*[x for step in path + over for x in step])
            out.append((r[0], leaf(r), own[s][0], root, proof, h, h == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def drawn(n, sources):
    draw = random.Random(n)
    texts = [None, "", "a\nb", "no line end", "é\r\n\n", "x" * 5000 + "\n"]
    return [(draw.choice([None, *range(0, 3 * n)]) if i % 9 == 0 else i, draw.choice(texts), draw.choice([None, "en", "dé"]), draw.choice(sources), draw.choice([None, 0, -3, 7])) for i in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 6])
@pytest.mark.parametrize("rows", [drawn(1, ["a"]), drawn(3, ["a"]), drawn(4, [None]), drawn(90, ["b", None, "", "é", "Z"]), drawn(60, ["b"] * 9 + [f"s{i}" for i in range(14)])], ids=["1", "3", "4", "90", "60"])
def test_manifest_is_the_restated_one(spark, monkeypatch, depth, rows):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    rows = rows + rows[: len(rows) // 8]
    df = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3)
    got = merkle.checked(df, merkle.without_line_ends())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(restated(rows), key=key)


def test_heights_and_no_rows(spark):
    found = spark.range(1, 5000).select("id", merkle.height(F.col("id")).alias("h")).collect()
    for r in found:
        assert 3 ** r["h"] >= r["id"] and (r["h"] == 0 or 3 ** (r["h"] - 1) < r["id"])
    assert merkle.checked(spark.createDataFrame([], DOCS), merkle.without_line_ends()).count() == 0
    plain = merkle.checked(spark.createDataFrame(drawn(30, ["a", "b"]), DOCS))
    assert plain.where("not verified").count() == 0 and plain.select("root").distinct().count() == 1


def test_numbers_within_groups_in_any_order(spark):
    from pricelink.operators.numbering import ranked

    draw = random.Random(3)
    rows = [(draw.choice(["a", None, "b", "c"][: 1 + i % 4]), draw.choice(["x", "y", None, "zz"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, t string, id long").repartition(7)
    got = {r["id"]: (r["place"], r["n"]) for r in ranked(df, ["g"], [F.desc_nulls_first("t"), F.col("id")], "place", "n").collect()}
    for g in ("a", None, "b", "c"):
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: ((r[1] is not None), [-ord(c) for c in r[1] or ""], r[2]))
        mine.sort(key=lambda r: r[2])
        mine.sort(key=lambda r: r[1] or "", reverse=True)
        mine.sort(key=lambda r: r[1] is not None)
        assert [got[r[2]] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    whole = ranked(df, [], [F.col("id").desc()], "place").collect()
    assert {r["id"]: r["place"] for r in whole} == {i: 500 - i for i in range(500)}
    assert ranked(df.limit(0), ["g"], [F.col("id")], "place").count() == 0
