"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pricelink.llm import bpe, dedup, langid, licenses, lm_score, mixing, quality, sharding, simhash, urlfilter
from pricelink.llm.queries import tokenizer_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


# 1


def test_mixing_meets_targets_and_caps(spark):
    rows = [(i, "w " * (5 + i % 7), "en", s, 0) for i, s in enumerate(["a"] * 60 + ["b"] * 6 + [None] * 30)] + [(500, None, "en", "z", 0), (501, "", None, "z", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 0.5
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6 and all(r["taken"] <= 3 * r["size"] for r in v)
    assert by["b"][0]["target"] == 3 * by["b"][0]["source_size"]
    rest = total - by["b"][0]["target"]
    # order a, b, z, null; weights 1, 2, 3, 1; z has no words
    assert by["a"][0]["target"] == pytest.approx(rest / 2) and by[None][0]["target"] == pytest.approx(rest / 2)
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)


def test_mixing_is_repeatable_and_takes_repeated_and_no_rows(spark):
    df = docs(spark, ["a b c"] * 3 + ["d"], source="q").union(docs(spark, ["a b c"] * 3, source="q"))
    a, b = ([tuple(r) for r in mixing.mix(df.repartition(n)).drop("positions").collect()] for n in (1, 3))
    assert sorted(a) == sorted(b) and sum(r[4] for r in a) == 19
    assert mixing.mix(docs(spark, [])).count() == 0
    clash = df.withColumn("size", F.lit("x")).withColumn("_size", F.lit("y")).withColumn("_n", F.lit("z")).withColumn("k2", F.create_map(F.lit(1), F.lit(2)))
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns and out.count() == 7 and {(r["size"], r["_size"], r["_n"]) for r in out.collect()} == {("x", "y", "z")}


def spark_hash(*values):
    """xxhash64 of a row of ints (Python's int is a long, a pair of an int and 4 an integer), strings and booleans."""
    import xxhash

    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little", signed=True) if isinstance(v, bool) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def test_mixing_is_the_restated_one(spark):
    sources = ["b"] * 80 + ["a"] * 9 + [None] * 25 + ["c"] * 40
    rows = [(i, "w " * (i * i % 11), "en", s, 0) for i, s in enumerate(sources)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    size = {i: i * i % 11 for i in range(len(rows))}
    order = ["a", "b", "c", None]
    own = {s: sum(size[i] for i, x in enumerate(sources) if x == s) for s in order}
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    # targets: share by weight, stop those above their cap, share again
    target, rest, free = {}, float(sum(own.values())), list(order)
    while free:
        fill = rest / sum(weight[s] for s in free)
        full = [s for s in free if fill * weight[s] > 3 * own[s]]
        if not full:
            target |= {s: fill * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3.0 * own[s]
            rest -= target[s]
            free.remove(s)
    for k, s in enumerate(order):
        goal, before = round(target[s]), 0
        mine = sorted((i for i, x in enumerate(sources) if x == s), key=lambda i: (spark_hash("words", i, size[i]) >> 11, i))
        for i in mine:
            r, full = got[i], goal // own[s]
            assert r["target"] == pytest.approx(target[s]) and r["taken"] == full * size[i] + min(size[i], max(0, goal - full * own[s] - before))
            if r["position"] is not None:
                # a source of even rank fades from 1.5 to 0.5, the others grow from 0.5 to 1.5; the integral at the position is the demand
                t = r["position"]
                area = 1.5 * t - t * t / 2 if k % 2 == 0 else 0.5 * t + t * t / 2
                assert area == pytest.approx(before / target[s], abs=1e-9)
            before += size[i]


def test_schedules_are_inverted(spark):
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.5, 2.0), ("a", 1.0, 2.0)], "src string, t double, w double")
    s = mixing.segments(knots).first()
    assert s["area"] == pytest.approx(1.5)
    xs = [0.0, 0.125, 0.5, 1.0, 1.5]
    got = mixing.segments(knots).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias("x"), "pieces").select(mixing.inverse(F.col("pieces"), F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])


# 2


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measurements(spark):
    texts = [None, "", " \n\t ", "a b c d e f a b c d e", "x " * 40, "l\nl\n\nl\nm", "é$ ½ # " * 6, " ".join(str(i % 9) for i in range(3000)), "\x85 a\x0bb \x1c"]
    got = {r["doc_id"]: r for r in quality.judged(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(docs(spark, [])).count() == 0


def test_rows_that_repeat_come_back_as_often_whatever_their_columns(spark):
    files, long = tokenizer_files(), "long word " * 60_000
    df = docs(spark, ["a b c", "a b c", long]).union(docs(spark, ["a b c"])).withColumn("n_words", F.lit("x")).withColumn("_t", F.lit("y")).withColumn("ids_", F.lit(1)).withColumn("_found", F.lit(2)).withColumn("slot_", F.lit(3))
    judged = quality.judged(df).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in judged) == [(0, 3), (0, 3), (1, 3), (2, 120_000)]
    tokens = bpe.encode(df, **files).collect()
    assert len(tokens) == 4 and len({bytes(r["ids"]) for r in tokens}) == 2 and {r["_found"] for r in tokens} == {2}
    en, de = sample_texts()
    langs = langid.identified(df, langid.fit([en, de], ["en", "de"])).collect()
    assert len(langs) == 4 and {r["_found"] for r in langs} == {2}
    assert sorted(r["size"] for r in mixing.mix(df).collect()) == [3, 3, 3, 120_000]
    placed = sharding.shard_documents(df, [1.0] * 2, [1.0] * 3).collect()
    assert sorted(r["size"] for r in placed) == [6, 6, 6, len(long) + 1] and len({r["shard"] for r in placed if r["doc_id"] == 0}) == 1


def test_quality_ablation(spark):
    found = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failures long")
    got = {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality.ablation(found, "v1").collect()}
    assert got["few_words"] == (3, 2) and got["repeated_words"] == (1, 0) and got["symbols"] == (1, 1) and got["upper_case"] == (0, 0)
    assert {r["rule"] for r in quality.ablation(found, "base").collect()} == {"few_words", "repeated_words"}


# 3


def test_licences(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    texts = [
        "Released under the MIT License.", "code\n" * 30 + "Licensed under the Apache License, Version 2.0.\n" + "x " * 200, "no header " * 20, None, "a licence to kill is not one of these many lines", "plain",
        "Copyright (c) 2020 Some Body\n\n" + wrapped, dict(licenses.TEXTS)["BSD-3-Clause"].replace("copyright holder", "University"), "y " * 90 + "\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n" + "z " * 90,
        "q " * 40 + "is here. Distributed under the terms of the GPL v3. " + "and more " * 40, "w " * 100_000 + "\nLicensed under CC BY 4.0.",
    ]
    folders = ["a", "a/b", "a/b", "a/b/c", "", "z", "m", "n", "o", "o", "o/p"]
    files = spark.createDataFrame([(i, t, f, "clash", 1) for i, (t, f) in enumerate(zip(texts, folders))] + [(2, texts[2], "a/b", "clash", 1)], "doc_id long, text string, folder string, license string, row int")
    rows = licenses.scan(files, licenses.templates(spark)).collect()
    got = {r["doc_id"]: (r["license"], r["how"], r["given_by"]) for r in rows}
    assert len(rows) == 12
    assert got == {
        0: ("MIT", "file", None), 1: ("Apache-2.0", "header", None), 2: ("MIT", "inherited", "a"), 3: ("MIT", "inherited", "a"), 4: (None, "none", None), 5: (None, "none", None),
        6: ("MIT", "file", None), 7: ("BSD-3-Clause", "file", None), 8: ("GPL-3.0", "header", None), 9: ("GPL-3.0", "header", None), 10: ("CC-BY-4.0", "header", None),
    }
    assert licenses.scan(files.limit(0), licenses.templates(spark)).count() == 0


def test_licence_bound_drops_nothing(spark):
    import math
    import random
    import re

    r = random.Random(8)
    lists = [Counter(re.findall(licenses.TOKEN, b.lower())) for _, b in licenses.HEADERS + licenses.TEXTS]
    df = Counter(t for x in lists for t in x)
    idf = {t: math.log((1 + len(lists)) / (1 + n)) + 1 for t, n in df.items()}
    unknown = math.log(1 + len(lists)) + 1
    cosine = lambda a, b: sum(a[t] * b[t] * idf[t] ** 2 for t in a.keys() & b.keys()) / math.sqrt(sum((n * idf.get(t, unknown)) ** 2 for t, n in a.items()) * sum((n * idf[t]) ** 2 for t, n in b.items()))
    units = []
    for _ in range(400):
        words = list(r.choice(lists).elements())
        r.shuffle(words)
        units.append(" ".join(words[: r.randint(1, len(words))] + [f"x{r.randint(0, 9)}" for _ in range(r.randint(0, 12))]))
    frame = spark.createDataFrame([(u,) for u in units], "unit string")
    weights = licenses.weighted_templates(licenses.templates(spark), len(lists))
    known = licenses.known_words(F.split("unit", " "), F.col("slots"))
    frame = frame.withColumn("slots", licenses.vocabulary(weights)).withColumn("u", licenses.as_unit(F.split("unit", " "), F.col("slots"))).where("u.unit <> ''").cache()
    kept = {x["unit"] for x in frame.where(licenses.possible(known, F.size(F.split("unit", " ")) - F.size(known), unknown)).collect()}
    scored = licenses.scored_parts(frame.select("u.*"), weights, unknown)
    found = {x["unit"]: x["cosine"] for x in frame.select(F.col("unit").alias("text"), "u.*").join(scored, ["unit", "strange"]).select(F.col("text").alias("unit"), "cosine").collect()}
    best = {u: max(cosine(Counter(u.split()), t) for t in lists) for u in units}
    assert all(u in kept and found[u] == pytest.approx(c, abs=1e-8) for u, c in best.items() if c >= 0.6)
    assert all(c >= 0.6 - 1e-9 for u, c in best.items() if u in found) and len(kept) < len(set(units))


# 4


def test_sharding(spark):
    rows = [(i if i != 7 else None, f"text {i % 5}", "en", "s", 0) for i in range(300)] + [(3, "text 3", "en", "s", 0)] * 4 + [(9, None, "en", "s", 0)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), [1.0] * 16, [1.0] * 17).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 16
    assert {r["shard"] for r in got if r["doc_id"] == 3} == {next(r["shard"] for r in got if r["doc_id"] == 3)}
    for r in got:
        if r["doc_id"] == 3 and r["size"] == 7:
            assert r["text_crc32"] == zlib.crc32(b"text 3")
    assert sharding.shard_documents(docs(spark, []), [1.0], [1.0, 1.0]).count() == 0


def test_sharding_is_the_restated_one(spark):
    import math

    weights = [1.0, 2.0, 0.5, 0.0, 1.0]
    ids = [*range(-20, 300), 2**62, None]
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["s"] for r in frame.withColumn("s", sharding.rendezvous(F.col("id"), weights)).collect()}
    for i in ids:
        u = [((spark_hash((k, 4), i is None, i) >> 11) + 0.5) * 2.0**-53 for k in range(len(weights))]
        score = [-w / math.log(x) if w else -1.0 for w, x in zip(weights, u)]
        assert got[i] == score.index(max(score))


def test_sharding_follows_weights(spark):
    ids = spark.range(4000)
    got = {r[0]: r[1] for r in ids.groupBy(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0])).count().collect()}
    assert set(got) == {0, 1} and abs(got[1] - 3000) < 150


# 5


def test_bpe_round_trip_and_safe_cuts(spark):
    files = tokenizer_files()
    texts = [None, "", "Hello  world's  12 ½\n\n  é日本 <|endoftext|>", "a" * 3000, " " * 500 + "x", "word  \n " * 4000, "\u0000�"]
    whole = bpe.load(**files)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(spark, texts), limit=100, **files), **files).collect()}
    for i, t in enumerate(texts):
        ids = whole.encode_ordinary(t or "")
        r = got[i]
        assert r["n_tokens"] == len(ids) and list(memoryview(bytes(r["ids"])).cast("I")) == ids and bytes(r["decoded"]) == (t or "").encode()
    assert bpe.encode(docs(spark, []), **files).count() == 0


def test_bpe_cuts_follow_the_tokenizers_white_space(tmp_path):
    import base64
    import re
    import sys

    ranks = [bytes([i]) for i in range(256)] + [b"}\x1e", b"}\x1e{"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    whole = bpe.load(str(tmp_path / "ranks"), tokenizer_files()["pattern"])
    ids = lambda t, limit: list(memoryview(bpe.encode_text(whole, t, limit)).cast("I"))
    for c in "\x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000 \n":
        text = f'{{"a": 1}}{c}{{}}{c}{c}x ' * 300
        assert ids(text, 7) == whole.encode_ordinary(text)
    text = "}\x1e{" * 70_000 + " end"
    assert ids("}\x1e{", 1) == [257]
    assert ids(text, bpe.PIECE_CHARS) == whole.encode_ordinary(text)
    spaces = {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()} - set("\x1c\x1d\x1e\x1f")
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if re.match(f"[{bpe.SPACE}]", c)} == spaces


# 6


def brute_groups(rows):
    plain = lambda t: "".join(c for c in t or "" if c not in "\t\n\x0b\x0c\r ")
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}, plain


@pytest.mark.parametrize("huge", [10, 1 << 22])
def test_exact_dedup(spark, monkeypatch, huge):
    texts = ["a b", "ab", " a\tb ", "abc", None, "", " \n", "é x" * 50, "éx" * 50, "z" * 200_000, "z " * 200_000, "y" + "z" * 199_999]
    rows = list(enumerate(texts)) + [(0, "a b"), (2, " a\tb "), (None, "abc")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want, plain = brute_groups(rows)
    got = dedup.exact_groups(df, huge).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        if r["doc_id"] is None:
            text = "abc"
        assert (r["keep_id"], r["group_size"]) == want[plain(text)]
        assert r["text_sha256"] == hashlib.sha256(plain(text).encode()).hexdigest()
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    clash = df.withColumn("sha", F.lit(1)).withColumn("_sha", F.lit(1)).withColumn("key", F.lit(None)).withColumn("stays", F.create_map(F.lit(1), F.lit(2)))
    out = dedup.without_copies(clash, huge)
    assert out.columns == clash.columns
    assert sorted(plain(r["text"]) for r in out.collect()) == sorted(want)
    assert {plain(r["text"]): r["doc_id"] for r in out.collect()} == {k: v[0] for k, v in want.items()}
    assert dedup.exact_groups(docs(spark, [])).count() == 0


def test_fingerprints_compose():
    data = bytes(range(256)) * 700
    cuts = [0, 5, 70_000, 70_001, len(data)]
    parts = [(dedup.text_hash(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]
    assert dedup.combine(iter(parts)) == dedup.text_hash(data)
    p = dedup.PRIMES[0]
    assert dedup.text_hash(b"abc")[0] == (97 * dedup.BASE**2 + 98 * dedup.BASE + 99) % p


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup, "COMPARED", 2)
    monkeypatch.setattr(dedup, "fingerprinted", lambda d, huge: dedup.keyed(d).groupBy(*dedup.KEY).agg(F.count(F.lit(1)).alias("copies")).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(2).cast("long")}))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup.exact_groups(docs(spark, ["aa", "bb", "b b", "a a ", "cc"])).collect()}
    assert got == {0: (3, 2), 3: (3, 2), 1: (2, 2), 2: (2, 2), 4: (4, 1)}


# 7


def sample_texts():
    en = "the house of the old man and the dog was in the garden near that river with many birds"
    de = "das Haus der alten Frau und der Hund waren nicht mit den Kindern auf dem schönen Berg"
    return en, de


def test_language_id(spark):
    en, de = sample_texts()
    model = langid.fit([en, de] * 20, ["en", "de"] * 20)
    rows = [en, de, None, "", "123 !?", en + " " + de + " " + de, en.upper(), "ß", (en + " ") * 9000]
    df = docs(spark, rows).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(df, model).collect()}
    assert [got[i][0] for i in (0, 1, 5, 6, 8)] == ["en", "de", "de", "en", "en"]
    assert [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3 and all(0 <= s <= 1 for _, s in got.values())
    assert 0.5 < got[5][1] < 0.9
    assert langid.identified(docs(spark, []), model).count() == 0
    none = langid.train(docs(spark, ["x"], lang=None))
    assert langid.identified(docs(spark, ["some text"]), none).first()["lang_pred"] == "und"


def test_forward_backward_is_exact_over_blocks():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    change, first = np.log(r.dirichlet([1, 1], 2)), np.log(r.dirichlet([1, 1]))
    lengths = np.array([3, 1, 9])
    scores = r.normal(size=(13, 2))
    got = langid.marginals(scores, lengths, change, first)
    block, langid.BLOCK = langid.BLOCK, 2
    assert np.allclose(got, langid.marginals(scores, lengths, change, first))
    langid.BLOCK = block
    at = 0
    for n in lengths:
        total = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            w = np.exp(first[path[0]] + sum(scores[at + t, s] for t, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                total[t, s] += w
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_language_of_long_texts_is_that_of_one_pass(spark, monkeypatch):
    import numpy as np

    en, de = sample_texts()
    model = langid.fit([en, de] * 20, ["en", "de"] * 20)
    text = " ".join([en, de, "12 ", de, en, en] * 40)
    monkeypatch.setattr(langid, "piece_chars", lambda k: 1 << 30)
    whole = langid.predict(model, [text, en])
    for size in (50, 1000, 5000):
        monkeypatch.setattr(langid, "piece_chars", lambda k: size)
        names, scores = langid.predict(model, [text, en])
        assert names == whole[0] and scores == pytest.approx(whole[1], abs=1e-9)
        assert np.array_equal(np.concatenate(list(langid.word_ends(langid.codes(text), size))), langid.codes(text))


def test_every_letter_and_language_counts(spark, monkeypatch):
    rare = "\U00030001\U00030002 \U00031350"
    en, _ = sample_texts()
    model = langid.fit([en, rare] * 5, ["en", "rare"] * 5)
    assert langid.predict(model, [rare])[0] == ["rare"] and langid.predict(model, ["\U00031360"])[0] != ["und"]
    monkeypatch.setattr(langid, "fit", lambda texts, labels: (texts, labels))
    rows = [(i, f"text {i}", f"l{i % 230:03}", "s", 0) for i in range(8000)] + [(9001 + i, "x" * 5000, "long", "s", 0) for i in range(3)]
    texts, labels = langid.train(spark.createDataFrame(rows, DOCS), rows=20)
    found = Counter(labels)
    assert len(found) == 231 and max(found.values()) == 20 and min(found.values()) <= 3 and max(map(len, texts)) < langid.TRAIN_CHARS + 9
    assert sum(v == 20 for v in found.values()) >= 200
    long = spark.createDataFrame([("a" * 900 + "b" * 900 + "c" * 900 + "d" * 900,), ("short",)], "text string")
    assert [r[0] for r in long.select(langid.sample_of(F.col("text"), 40)).collect()] == ["\n".join(["a" * 10, "b" * 10, "c" * 10, "d" * 10]), "short"]


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identified(df, langid.train(df)).where(langid.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.95


# 8


def test_url_filter(spark):
    urls = {
        "http://A.example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://x.net/": ("x.net", "/", "net/", "block"),
        "https://x.net": ("x.net", "", None, "allow"),
        "http://example.com/de/1#t": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "http://w.casino-win.example.org/fr/1": ("w.casino-win.example.org", "/fr/1", "org/fr/", "allow"),
        "http://w.casino-win.example.org/en/1": ("w.casino-win.example.org", "/en/1", None, "block"),
        "http://me@W.Casino-Win.example.org:80/x": ("me@w.casino-win.example.org:80", "/x", None, "block"),
        "http://casino-win.example.org./x": ("casino-win.example.org.", "/x", None, "block"),
        "http://xcasino-win.example.org/": ("xcasino-win.example.org", "/", None, "allow"),
        "http://x.net:80/": ("x.net:80", "/", None, "allow"),
        f"http://{'a.' * 20000}casino-win.example.org/{'p' * 20000}": ("a." * 20000 + "casino-win.example.org", "/" + "p" * 20000, None, "block"),
        f"http://{'b' * 20000}.net/": ("b" * 20000 + ".net", "/", "net/", "block"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://?": ("", "", None, "allow"),
    }
    order = list(urls)
    rows = [(i, u, "clash") for i, u in enumerate(order)] + [(1, order[1], "clash"), (None, order[1], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urlfilter.judged(pages, urlfilter.policy(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[order[1 if r["page_id"] is None else r["page_id"]]]
    assert urlfilter.judged(pages.limit(0), urlfilter.policy(spark)).count() == 0
    assert {r["verdict"] for r in urlfilter.judged(pages, urlfilter.policy(spark).limit(0)).collect()} == {"allow"}


def test_full_filter_changes_nothing(spark):
    entries = spark.range(500).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("").alias("path"), F.lit("block").alias("verdict"), F.lit(1).alias("class"))
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/")).alias("url"))
    for blocks in (1, 1 << 10):
        found = urlfilter.matches(pages, entries, max_blocks=blocks)
        assert found.where(F.size("hits") == 1).count() == 500 and found.count() == 1000


# 9


def brute_fingerprint(text, run=4):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + run]), 42) for i in range(max(1, len(words) - run + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, near):
    """Least id reachable, for ids with fingerprints."""
    least = {}
    for i in prints:
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in prints:
                if b not in seen and near(prints[a], prints[b]):
                    seen.add(b)
                    todo.append(b)
        least[i] = min(seen)
    return least


def test_simhash_components(spark):
    import random

    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(150)) for _ in range(12)]
    texts = base + [" ".join(w if r.random() > p else "new" for w in t.split()) for t in base for p in (0.002, 0.004, 0.008, 0.02)]
    texts += [None, "", " ", "Ab", "aB", base[0]]
    ids = [100 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)] + [(100, texts[0], "en", "s", 0)], DOCS)
    got = simhash.clusters(df.withColumn("fp", F.lit("clash"))).withColumn("x", simhash.hexadecimal(F.get("lanes", F.lit(0)))).collect()
    prints = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    least = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(got) == len(texts) + 1
    assert all((r["x"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", least[r["doc_id"]]) for r in got)
    assert simhash.clusters(docs(spark, [])).count() == 0


@pytest.mark.parametrize("plan", [p for limit in (2, 4, 7) for p in simhash.plans(limit)])
def test_every_plan_finds_each_pair_once(spark, plan):
    import random

    limit = sum(plan[1]) + len(plan[1]) - 1
    r = random.Random(3)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        prints.add(x)
        for k in range(limit + 3):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), signed(x)) for x in prints], "id long, fp long")
    got = [(a["u"], a["v"]) for a in simhash.links(nodes, limit, plan).collect()]
    want = {(signed(a), signed(b)) for a in prints for b in prints if signed(a) > signed(b) and (a ^ b).bit_count() <= limit}
    assert len(got) == len(set(got)) and set(got) == want


def near_copies(r, n, words, changes, vocabulary=5000):
    """n texts with a copy each, of which `changes` words are others."""
    texts = []
    for _ in range(n):
        first = [f"w{r.randint(0, vocabulary)}" for _ in range(words)]
        copy = list(first)
        for at in r.sample(range(words), changes):
            copy[at] = "new"
        texts += [" ".join(first), " ".join(copy)]
    return texts


def test_near_dedup_recall_against_brute_force(spark):
    import random

    import corpus_pipeline

    r = random.Random(11)
    # changes of 400 words that give similarities from 0.8 (nine words) to 0.95
    texts = [t for k in (2, 4, 6, 8, 9) for t in near_copies(r, 60, 400, k)] + [t for k in (30, 60) for t in near_copies(r, 20, 400, k)]
    runs = [frozenset(tuple(t.split()[i : i + 5]) for i in range(396)) for t in texts]
    holders = defaultdict(set)
    for i, found in enumerate(runs):
        for x in found:
            holders[x].add(i)
    pairs = {(a, b) for i, found in enumerate(runs) for x in found for a, b in [(i, j) for j in holders[x] if j < i]}
    share = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a, b in pairs}
    alike = {p for p, j in share.items() if j >= 0.8}
    least = sorted(p for p in alike if share[p] < 0.82)
    assert len(alike) >= 250 and len(least) >= 30
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(docs(spark, texts), corpus_pipeline.NEAR_BITS).collect()}
    assert sum(comp[a] == comp[b] for a, b in alike) >= 0.95 * len(alike)
    assert sum(comp[a] == comp[b] for a, b in least) >= 0.9 * len(least)
    assert all(comp[a] != comp[b] for (a, b), j in share.items() if j < 0.6)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()}
    assert kept == set(comp.values())


@pytest.mark.parametrize("n", [10**4, 10**6, 10**7, 10**8, 10**9, 10**10])
def test_candidates_keep_recall_and_rows_at_every_size(n):
    """Measured on pairs of sets at a similarity of 0.8, with the distance of their fingerprints: neither the rows a document nor
    what is found depends on n; chance matches of a key do, and stay below one a document."""
    import numpy as np

    draw = np.random.default_rng(n)
    found, kept, trials = 0, 0, 600
    for _ in range(trials):
        shared, own, other = (draw.integers(0, 1 << 64, k, np.uint64, endpoint=False) for k in (320, 40, 40))
        sides = [np.concatenate((shared, x)) for x in (own, other)]
        keys = [simhash.band_keys(simhash.least_values(x)) for x in sides]
        hit = bool(set(keys[0]) & set(keys[1]))
        bits = sum(int(np.sum(np.abs(np.diff([2 * np.unpackbits(simhash.mixed(x, lane).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) > len(x) for x in sides], axis=0)))) for lane in range(4))
        found, kept = found + hit, kept + (hit and bits <= 48)
    assert simhash.BANDS == len(keys[0]) == 20 and simhash.BANDS * n / 2.0**64 < 1
    assert found / trials > 0.985 and kept / trials >= 0.9


def test_near_links_are_true_and_found_by_bands(spark):
    import random

    r = random.Random(2)
    texts = near_copies(r, 150, 400, 7)
    nodes = simhash.printed(docs(spark, texts), 5, 4, {"doc_id": F.col("doc_id")}, True)[1].withColumn("comp", F.col("id"))
    rows = {x["id"]: x for x in nodes.collect()}
    pairs = {(p["u"], p["v"]) for p in simhash.across(nodes, 4, 48).collect()}
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(rows[a]["lanes"], rows[b]["lanes"]))
    assert all(u > v and apart(u, v) <= 48 for u, v in pairs)
    by = {x["least"]: i for i, x in rows.items()}
    near = [tuple(sorted((by[2 * i], by[2 * i + 1]), reverse=True)) for i in range(150)]
    assert len({p for p in near if apart(*p) <= 48} & pairs) >= 0.98 * sum(apart(*p) <= 48 for p in near)


def spread(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))


def repeating(r, n, passage, times, own):
    """n texts that repeat one passage and end in words of their own."""
    same = [f"w{r.randint(0, 10**6)}" for _ in range(passage)] * times
    return [" ".join(same + [f"w{r.randint(0, 10**6)}" for _ in range(own)]) for _ in range(n)]


def test_near_dedup_finds_close_fingerprints_without_a_band(spark):
    import random

    import corpus_pipeline

    r = random.Random(6)
    pairs = [repeating(r, 2, 60, 60, 300) for _ in range(20)]
    prints = [[simhash.fingerprint(t, 5, 4, True) for t in pair] for pair in pairs]
    assert all(not set(a[1]) & set(b[1]) for a, b in prints)
    near = [i for i, (a, b) in enumerate(prints) if spread(a[0], b[0]) <= 19]
    assert len(near) >= 10
    table = docs(spark, [t for pair in pairs for t in pair])
    comp = {x["doc_id"]: x["component_id"] for x in simhash.near_clusters(table, corpus_pipeline.NEAR_BITS).collect()}
    assert all(comp[2 * i] == comp[2 * i + 1] for i in near)
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, table, "").collect()}
    assert all(2 * i in kept and 2 * i + 1 not in kept for i in near) and kept == set(comp.values())


@pytest.mark.parametrize("plan", simhash.plans(4))
@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_index_over_all_lanes_is_complete(spark, plan, crowd):
    import random

    r = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    codes = []
    for _ in range(8):
        x = r.getrandbits(256)
        codes += [x] + [x ^ sum(1 << b for b in r.sample(range(256), k)) for k in (1, 5, 10, 19, 19, 19, 30, 48, 60)]
        codes += [x ^ 1 << b for b in range(8)]
    lanes = [[signed(c >> 64 * k & (1 << 64) - 1) for k in range(4)] for c in codes]
    # some are in one component already, a crowd where few are needed
    comp = [i - i % 18 + 10 if i % 18 >= 10 else i for i in range(len(codes))]
    nodes = spark.createDataFrame(list(zip(range(len(codes)), lanes, comp)), "id long, lanes array<long>, comp long")
    got = [(p["u"], p["v"]) for p in simhash.indexed(nodes, 4, 48, plan, crowd).collect()]
    within = lambda most: {(max(comp[i], comp[j]), min(comp[i], comp[j])) for i in range(len(codes)) for j in range(i) if comp[i] != comp[j] and spread(lanes[i], lanes[j]) <= most}
    assert len(got) == len(set(got)) and within(19) <= set(got) <= within(48)


@pytest.mark.parametrize("widths, radii", simhash.plans(4))
def test_keys_of_the_index_are_segments_within_their_radius(spark, widths, radii):
    import random

    r = random.Random(9)
    lanes = [[r.getrandbits(63) - r.getrandbits(63) for _ in range(4)] for _ in range(3)]
    got = spark.createDataFrame([(x,) for x in lanes], "lanes array<long>").select("lanes", simhash.ball_keys(4, widths, [x - x // 2 for x in radii]).alias("keys")).collect()
    for row in got:
        want, segment = set(), 0
        for x in row["lanes"]:
            rest = x & (1 << 64) - 1
            for width, radius in zip(widths, radii):
                want |= {segment << 32 | rest % (1 << width) ^ d for d in simhash.flips(width, radius - radius // 2)}
                rest, segment = rest >> width, segment + 1
        assert len(row["keys"]) == len(want) and set(row["keys"]) == want


def test_a_dense_group_without_bands_is_tied_too(spark):
    import random

    nodes = simhash.printed(docs(spark, repeating(random.Random(7), 200, 60, 100, 200)), 5, 4, {"doc_id": F.col("doc_id")}, True)[1].cache()
    buckets = nodes.withColumn("bands", simhash.halves(4))
    tied = simhash.merged(nodes, simhash.verified(simhash.ties(buckets), nodes, 48))
    assert nodes.count() > 150 and simhash.ties(buckets).count() <= 8 * nodes.count()
    assert tied.select("comp").distinct().count() <= 10


def test_a_dense_group_is_tied_before_pairs_are_sought(spark):
    import random

    r = random.Random(4)
    words = [f"w{r.randint(0, 5000)}" for _ in range(400)]
    texts = []
    for _ in range(300):
        copy = list(words)
        for at in r.sample(range(400), 2):
            copy[at] = f"new{r.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    prints, nodes = simhash.printed(docs(spark, texts), 5, 4, {"doc_id": F.col("doc_id")}, True)
    ties = simhash.ties(nodes)
    assert ties.count() <= simhash.BANDS * nodes.count()
    tied = simhash.merged(nodes, simhash.verified(ties, nodes, 48))
    assert tied.select("comp").distinct().count() <= 5
    assert simhash.across(tied, 4, 48).count() <= 20 * 300
    assert {r["component_id"] for r in simhash.near_clusters(docs(spark, texts), 48).collect()} == {0}


def test_first_of_each_keeps_columns_and_takes_any_names(spark):
    base = [" ".join(f"w{(i * 31 + k * k) % 997}" for k in range(200)) for i in range(6)]
    texts = [*base, *base, None, "", base[0] + " more"]
    rows = [(100 - i if i % 7 else None, t, {"k": i % 6}, i % 6, "x") for i, t in enumerate(texts)] + [(99, base[1], {"k": 1}, 1, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, _row map<string,int>, _id int, comp string").withColumn("_bloom", F.lit(1)).withColumn("key", F.lit("k"))
    kept = simhash.first_of_each(df, 48)
    got = kept.collect()
    assert kept.columns == df.columns and len(got) == len({r["text"] or "" for r in got}) == 7
    assert {r["doc_id"] for r in got if r["text"] == base[1]} == {99}
    assert simhash.first_of_each(df.limit(0), 48).count() == 0


# 10


def test_lm_score(spark):
    good, bad = "the model reads clean prose and learns", "buy cheap pills now click here"
    texts = [f"{good} {i}" for i in range(20)] + [f"{bad} {100 + i}" for i in range(60)] + [None, "", " \n"]
    df = docs(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("_row", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(0, 1), (0, 0), (30, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_score.scored(df, lm_score.good_documents(labels)).collect()}
    assert all(got[i]["score"] < 0 for i in range(20)) and all(got[i]["score"] > 0 for i in range(20, 80))
    assert all(got[i]["n_words"] == 0 and got[i]["score"] is None for i in (80, 81, 82))
    assert lm_score.scored(docs(spark, []), lm_score.good_documents(labels)).count() == 0
    none = lm_score.scored(df, labels.where("quality > 5").select("doc_id")).where("score is not null").select("target_loss")
    assert none.count() == 80


def brute_losses(texts, wanted):
    import math

    lower = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").split(" ") if w]
    tokens = [[*w, ""] if w else [] for w in map(lower, texts)]
    size = len({x for w in tokens for x in w if x})
    for d, w in enumerate(tokens):
        out = []
        for side in ("target", "background"):
            others = [x for i, x in enumerate(tokens) if i != d and (side == "background" or wanted[i])]
            one, two = Counter(x for o in others for x in o), Counter(p for o in others for p in zip(["", *o], o))
            total = 0
            for a, b in zip(["", *w], w):
                alone = (one[b] + 1) / (one.total() + size + 1)
                p = 0.7 * two[a, b] / one[a] + 0.3 * alone if one[a] else alone
                total += round(-math.log(p) * 1e6)
            out.append(total / 1e6 / len(w) if w else None)
        yield len(w[:-1]), *out


@pytest.mark.parametrize("block, one_hop", [(2000, 1 << 14), (2000, 3), (400, 20), (1 << 24, 1 << 14)])
def test_lm_losses_are_those_of_the_other_documents(spark, monkeypatch, block, one_hop):
    texts = [" ".join(f"w{(i * 911 + k * k * 31 + k) % 301}" for k in range(i % 40)) + (" The the" if i % 3 else "") for i in range(120)] + [None, "", "é x É", "only once here"]
    texts += texts[20:30] + ["twice told tale"] * 2 + ["x\ny " * 700]
    wanted = [i % 4 == 0 for i in range(len(texts))]
    target = spark.createDataFrame([(i,) for i, w in enumerate(wanted) if w] + [(4,)], "id long")
    monkeypatch.setattr(lm_score, "PIECE_BYTES", 500)
    monkeypatch.setattr(lm_score, "ONE_HOP", one_hop)
    got = {r["doc_id"]: r for r in lm_score.scored(docs(spark, texts), target, block_bytes=block).collect()}
    assert len(got) == len(texts)
    for i, (n, t, b) in enumerate(brute_losses(texts, wanted)):
        assert got[i]["n_words"] == n
        for name, want in (("target_loss", t), ("background_loss", b)):
            assert got[i][name] == (None if want is None else pytest.approx(want, abs=1e-6))
    # a text that occurs twice is known to the background, one that occurs once is not
    assert got[len(texts) - 2]["background_loss"] < got[123]["background_loss"] - 1


def test_lm_counts_of_a_block_grow_little_with_the_number_of_blocks():
    import numpy as np
    import pandas as pd

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].tolist()
    block = lm_score.Block(texts, np.zeros(len(texts), bool))
    assert lm_score.teams(1) == lm_score.teams(lm_score.ONE_HOP) == 1 and lm_score.teams(250_000) == 500 and lm_score.teams(250_001) == 501
    size = {}
    for n in (125, 7_500, 250_000, 25_000_000):
        m = lm_score.teams(n)
        names, parts = lm_score.rows_of(block.keys, block.target, block.background, n if m == 1 else m)
        assert len(names) <= max(lm_score.ONE_HOP, m) and (np.diff(names) > 0).all()
        size[n] = sum(len(x) for p in parts for x in p) + 16 * len(names)
    assert size[7_500] < 2 * size[125] and size[250_000] < 2 * size[125] and size[25_000_000] < 2 * size[125]


def test_lm_probabilities_add_up():
    import math

    import numpy as np

    known = ["a b a c", "b a", "c c d a"]
    for wanted in (True, False):
        for a in "abcd":
            total = 0.0
            for b in ["a", "b", "c", "d", ""]:
                loss = lambda text: list(brute_losses([*known, text], [wanted] * 3 + [False]))[3][1 if wanted else 2] * (len(text.split()) + 1)
                block = lm_score.Block([*known, f"{a} {b}"], np.array([wanted] * 3 + [False]))
                mine = block.losses({"target": block.target, "background": block.background}, 4)
                assert mine["target_loss" if wanted else "background_loss"][3] / 1e6 == pytest.approx(loss(f"{a} {b}"), abs=1e-4)
                # of start a b end, all but the pair (a, b) is in start a end or in start b end
                ends = {"": 0.0} | {x: lm_pair(known, x, "") for x in "abcd"}
                total += math.exp(-(loss(f"{a} {b}") - lm_pair(known, "", a) - ends[b]))
            assert total == pytest.approx(1, abs=1e-4)


def lm_pair(known, a, b):
    """The loss of one pair by the definition, with four words in the corpus."""
    import math

    texts = [[*t.split(), ""] for t in known]
    one, two = Counter(x for t in texts for x in t), Counter(p for t in texts for p in zip(["", *t], t))
    alone = (one[b] + 1) / (one.total() + 5)
    return -math.log(0.7 * two[a, b] / one[a] + 0.3 * alone if one[a] else alone)
