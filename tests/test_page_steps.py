"""The steps on pages of words against a plain restatement, and what they exchange."""

import random

from pyspark.sql import functions as F

from pricelink.functions import text
from pricelink.operators import layout
from pricelink.plans.queries import QUERIES
from pricelink.sources.files import SCHEMAS

DATA = "/root/testdata/sf0.001"


def odd_words(seed):
    """Pages whose lines drift, so that near neighbours reach further than a line, with ties, blanks and values that are no numbers."""
    r = random.Random(seed)
    words = []
    for page in range(30):
        y = 10.0
        for _ in range(r.randint(1, 25)):
            y += r.choice([0.0, 0.5, 1.0, 2.0, 2.5, 2.6, 9.0])
            x = r.choice([10.0, 20.0, 26.0, 30.0, 31.0, 40.0, float("nan")])
            words.append((1, page, 792.0, r.choice(["a", " b ", "c  d", "", None, " ", "Prîce", "e\n", "f"]), x, x + r.choice([2.0, 5.0, 9.0]), y if r.random() < 0.97 else float("nan")))
    return words


def lines_of(words):
    """(page, line, line_y, words) one word after the other."""
    found = []
    kept = sorted(((p, y, x, e, " ".join(t.replace(" ", " ").split())) for _, p, _, t, x, e, y in words if t and t.replace(" ", " ").strip()), key=lambda w: (w[0], *[(v != v, 0 if v != v else v) for v in w[1:4]], w[4]))
    for p, y, x, e, t in kept:
        if not found or found[-1][0] != p or not y - found[-1][1] <= layout.LINE_GAP:
            found.append((p, y, []))
        found[-1][2].append((x, y, e, t))
    return found


def test_lines_that_drift(spark):
    words = odd_words(3)
    got = layout.cut_lines(spark.createDataFrame(words, SCHEMAS["fragments"])).select("page", "line_y", F.size("_line").alias("n")).collect()
    want = lines_of(words)
    assert sorted((r["page"], repr(r["line_y"]), r["n"]) for r in got) == sorted((p, repr(y), len(w)) for p, y, w in want)
    near = [(a[1], b[1]) for a, b in zip(want, want[1:]) if a[0] == b[0]]
    assert any(len(w) > 1 for _, _, w in want) and any(b - a < 5 for a, b in near)


def test_cells_and_texts_line_by_line(spark):
    """Made of a line's array, cells and texts are those that are made of rows of words."""
    words = [w for w in odd_words(4) if w[4] == w[4] and w[6] == w[6]]
    rows = spark.createDataFrame(words, SCHEMAS["fragments"])
    by_rows = layout.line_cells(layout.page_lines(rows))
    columns = ["page", "line_no", "line_y", "cell_no", "text", "x", "end_x", "y"]
    every = lambda df, names: sorted(map(repr, df.select(*names).collect()))
    assert every(layout.page_cells(rows), columns) == every(by_rows, columns)
    columns = ["page", "line_no", "line_y", "text"]
    assert every(layout.page_texts(rows), columns) == every(layout.line_texts(by_rows), columns)


def test_tidy_is_clean_text(spark):
    values = ["", None, " ", "a", " a", "a ", "a  b", "a b", "a\n", "\ta", "a\u001cb", "Prîce", "x y", "　", "~!", "a\r\n"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select(text.clean_text(F.col("v")).alias("c"), text.tidy(F.col("v")).alias("t"), F.coalesce(text.has_text(F.col("v")), F.lit(False)).alias("h")).collect()
    assert all(r["c"] == r["t"] and r["h"] == (r["c"] != "") for r in got)


def test_words_are_not_exchanged(spark):
    """Lines, cells and texts of the view are made where its order rows lie: no exchange but those of the rows themselves."""
    for name in ("line_cells", "line_text"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == 1, plan
