"""The matcher against a plain restatement of its rules, and its blocking against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pricelink.functions.features import FEATURES, with_features
from pricelink.functions.similarity import char_counts, lcs_codes, lcs_masks, score_pairs, text_ratio
from pricelink.functions.similarity import lcs_ratio as ratio_of_subsequence
from pricelink.operators import matching
from pricelink.plans import queries

STORES = ["A", "B", "C"]
WORDS = ["chicken", "breast", "pollo", "frozen", "fresh", "red", "rojo", "onion", "bag", "10", "20", "5lb", "units", "whole", "cheese", "slices", "tomates"]


def catalog(seed):
    r = random.Random(seed)
    rows = []
    for n, store in enumerate(STORES):
        for _ in range(25):
            name = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 5)))
            rows.append((store, n, name if r.random() < 0.9 else f"{name} {r.randint(1, 3)}", name.upper(), r.choice([None, 0.0, 1.5, 2.0, 3.25])))
    return rows


LISTING = "store string, store_ord int, product_key string, product_name string, price double"


def similarity(a, b):
    if not a["tokens"] or not b["tokens"]:
        return 0.0
    clash = {("fresh", "canned"), ("fresh", "frozen")}
    if any((x, y) in clash or (y, x) in clash for x in a["states"] for y in b["states"]):
        return 0.0
    sets = {c: (set(a[c]), set(b[c])) for c in ("tokens", "strong", "numbers", "categories")}
    both = {c: x & y for c, (x, y) in sets.items()}
    ratio = SequenceMatcher(None, a["canonical_text"], b["canonical_text"]).ratio()
    if not both["strong"] and len(both["tokens"]) < 2 and ratio < 0.78:
        return 0.0
    if all(sets["numbers"]) and not both["numbers"]:
        return 0.0
    jaccard = len(both["tokens"]) / len(sets["tokens"][0] | sets["tokens"][1])
    contained = len(both["tokens"]) / min(map(len, sets["tokens"]))
    score = 0.44 * max(jaccard, contained) + 0.30 * ratio + 0.26 * len(both["strong"]) / max(1, min(map(len, sets["strong"])))
    score += 0.07 * bool(both["numbers"])
    if all(sets["categories"]):
        score += 0.05 if both["categories"] else -0.22
    return max(0.0, min(1.0, score))


def restated(items, features, threshold, margin):
    """Clusters as lists of (store, key), stores one after the other, greedily."""
    clusters = []
    for store in STORES:
        found = []
        for key, name in sorted((k, n) for s, k, n in items if s == store):
            best = (None, 0.0, 0.0)
            for i, members in enumerate(clusters):
                if any(s == store for s, _, _ in members):
                    continue
                if any(k == key for _, k, _ in members):
                    best = (i, 1.0, 0.0)
                    break
                score = max(similarity(features[name], features[n]) for _, _, n in members)
                if score > best[1]:
                    best = (i, score, best[1])
                elif score > best[2]:
                    best = (best[0], best[1], score)
            found.append((key, name, *best))
        used, taken = set(), set()
        for key, name, i, score, second in sorted(found, key=lambda x: -x[3]):
            if i is not None and score >= threshold and score - second >= margin and i not in used:
                used.add(i)
                taken.add(key)
                clusters[i].append((store, key, name))
        clusters += [[(store, key, name)] for key, name, *_ in found if key not in taken]
    return sorted(sorted((s, k) for s, k, _ in c) for c in clusters)


def clusters_of(bundle):
    groups = {}
    for r in bundle.members.collect():
        groups.setdefault(r["cluster_id"], []).append((r["store"], r["product_key"]))
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_matcher_is_the_restated_one(spark, seed):
    listings = spark.createDataFrame(catalog(seed), LISTING)
    bundle = matching.compare(listings, STORES)
    items = [(r["store"], r["product_key"], r["product_name"]) for r in matching.build_catalog(listings).collect()]
    features = {r["product_name"]: r.asDict() for r in with_features(listings.select("product_name").distinct()).collect()}
    assert clusters_of(bundle) == restated(items, features, 0.5, 0.06)


def test_blocking_loses_nothing(spark):
    listings = spark.createDataFrame(catalog(3), LISTING)
    assert clusters_of(matching.compare(listings, STORES)) == clusters_of(matching.compare(listings, STORES, blocked=False))


def test_saved_relations_come_first(spark):
    rows = [("A", 0, "k1", "Alpha one", 1.0), ("B", 1, "k2", "Beta two", 2.0), ("C", 2, "k2", "Gamma three", None), ("B", 1, "k3", "Delta", 4.0)]
    manual = [(1, "", 0, "A", "k1"), (1, "", 1, "B", "DELTA"), (2, "Named", 0, "A", "k1"), (2, "Named", 1, "C", "gamma THREE"), (3, "x", 0, "A", "missing")]
    bundle = matching.compare(spark.createDataFrame(rows, LISTING), STORES, spark.createDataFrame(manual, "manual_ord long, product_name string, store_pos int, store string, ref string"))
    got = {(r["Product"], r["A"], r["B"], r["C"]) for r in bundle.comparison().collect()}
    assert got == {("Alpha one", 1.0, 4.0, None), ("Named", None, 2.0, None)}
    assert {r["Product"]: r["Match Source"] for r in bundle.relations().collect()} == {"Alpha one": "manual", "Named": "manual"}
    assert [(r[0], r[1]) for r in bundle.ranking().collect()] == [("A", 1), ("B", 1), ("C", 0)]


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return 1.0 if a == b else 2 * row[-1] / (len(a) + len(b))


def test_subsequences_over_several_words(spark):
    r = random.Random(8)
    pairs = [("".join(r.choice("abcd "[: r.randint(1, 5)]) for _ in range(n)), "".join(r.choice("abcd ") for _ in range(m))) for n in (1, 61, 62, 63, 124, 125, 200) for m in (0, 1, 62, 130)] + [("", ""), ("", "x")]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(text_ratio(F.col("a"), F.col("b"), "lcs").alias("x")).collect()
    assert [x["x"] for x in got] == [lcs_ratio(a, b) if a or b else 1.0 for a, b in pairs]


def test_subsequences_with_masks_made_once_a_text(spark):
    r = random.Random(9)
    pairs = [("".join(r.choice("abcd ~7"[: r.randint(1, 7)]) for _ in range(n)), "".join(r.choice("abcd ~") for _ in range(m))) for n in (1, 2, 30, 61, 62, 63, 90) for m in (0, 1, 40, 62, 130)]
    pairs += [("", "x"), ("é a", "e a"), ("e a", "é a"), ("a\tb", "ab"), ("same", "same"), ("", "")]
    a, b = F.col("a"), F.col("b")
    made = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (None, "a")])], "i int, a string, b string").withColumns({"m": lcs_masks(a), "c": lcs_codes(b)})
    got = made.orderBy("i").select(ratio_of_subsequence(a, b, F.col("m"), F.col("c")).alias("x"), F.col("m").isNotNull().alias("short"), F.col("c").isNotNull().alias("plain")).collect()
    assert [x["x"] for x in got] == [lcs_ratio(a, b) if a or b else 1.0 for a, b in pairs] + [None]
    assert [x["short"] for x in got] == [len(a) <= 62 and a.isascii() and a.isprintable() for a, _ in pairs] + [False]
    assert [x["plain"] for x in got] == [b.isascii() and b.isprintable() for _, b in pairs] + [True]


def test_pairs_of_one_number_are_dealt(spark):
    """Names that all share one number: their pairs lie in several tasks, and none is lost or met twice."""
    names = [(s, f"word{chr(97 + i // 8) * 2}{chr(97 + i % 8) * 2} beef 10 CT") for s in ("SYSCO", "KOHL") for i in range(40)]
    got = queries.overlapping(spark.createDataFrame(names, "store string, product_name string")).select("a_name", "b_name", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 1600 and len({(x["a_name"], x["b_name"]) for x in got}) == 1600
    assert len({x["task"] for x in got}) > 1


def test_text_ratios(spark):
    pairs = [("abc def", "abd def"), ("a", ""), ("same", "same"), ("x" * 250 + "ab", "y" + "x" * 230 + "ab"), (None, "a")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = rows.orderBy("i").select(text_ratio(F.col("a"), F.col("b")), text_ratio(F.col("a"), F.col("b"), "lcs")).collect()
    for (a, b), (ratio, lcs) in zip(pairs, got):
        if a is None:
            assert ratio is None and lcs is None
        else:
            assert ratio == SequenceMatcher(None, a, b).ratio() and lcs == lcs_ratio(a, b)


def test_pairs_left_out_cannot_reach_the_bound(spark):
    r = random.Random(5)
    names = sorted({" ".join(r.choice(WORDS) for _ in range(r.randint(1, 5))) for _ in range(30)} | {"", "aa  aab"})
    rows = with_features(spark.createDataFrame([(n,) for n in names], "product_name string")).withColumn("chars", char_counts(F.col("canonical_text")))
    a, b = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in [*FEATURES, "chars", "product_name"]]) for p in "ab")
    pairs, key = a.crossJoin(b), ["a_product_name", "b_product_name"]
    features = {x["product_name"]: x.asDict() for x in rows.collect()}
    for at_least in (0.44, 0.8):
        got = {(x[0], x[1]): x[2] for x in score_pairs(pairs, at_least=at_least).select(*key, "score").collect()}
        every = {(x, y): similarity(features[x], features[y]) for x in names for y in names}
        assert {k for k, v in every.items() if v >= at_least} <= set(got)
        assert all(abs(v - every[k]) < 1e-9 for k, v in got.items())
    assert len(set(features["aa  aab"]["chars"])) == 6


def test_features_of_odd_names(spark):
    names = ["Fresh Whole", "12 units", "boneless estables", None]
    got = {r["product_name"]: [r[c] for c in FEATURES] for r in with_features(spark.createDataFrame([(n,) for n in names], "product_name string")).collect()}
    assert got["Fresh Whole"] == ["", [], [], [], [], ["fresh"]]
    assert got["12 units"][1] == ["12", "unit"] and got["boneless estables"][0] == "boneles establ" and got[None][1] == []
