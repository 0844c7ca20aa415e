"""Views that Spark reads in another form than their SQL."""

from pricelink.sources import views

DATA = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_pairs_by_equal_keys(spark):
    """Next parts are met by equal keys, not every part with every part, also with gaps, repeats, nulls and negative keys."""
    part = spark.createDataFrame([(k, f"red {k}", f"TYPE {k % 3}", 1 + k % 5) for k in (-2, -1, 1, 2, 2, 3, 6, 8, 9, 40)] + [(None, "none", "TYPE", 1)], "p_partkey long, p_name string, p_type string, p_size int")
    whole = spark.sql(views.VIEWS["name_pairs"], part=part)
    found = spark.sql(views.IN_SPARK["name_pairs"], part=part)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    plan = executed(views.view(spark, DATA, "name_pairs"))
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "p_partkey" not in "".join(line.split("NestedLoopJoin", 1)[1] for line in plan.splitlines() if "NestedLoopJoin" in line)


def test_fragments_in_one_pass(spark):
    """The same rows as by the view's SQL, with repeats, nulls and line numbers of all kinds, without an exchange of words."""
    rows = [(d, k, s, n, 1.0) for d, k, s, n in ((1, 10, 5, 1), (1, 11, 105, 2), (1, 10, 5, 1), (2, 12, 7, 7), (3, 99, 7, 1), (None, 10, 1, 2), (None, 12, 1, None), (4, None, 1, 1))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double")
    part = spark.createDataFrame([(10, "red bolt", "TYPE", 5), (11, "blue", "", 6), (12, None, "X", None)], "p_partkey long, p_name string, p_type string, p_size int")
    whole, found = (spark.sql(form["fragments"], order_rows=spark.sql(form["order_rows"], lineitem=lines, part=part)) for form in (views.VIEWS, views.IN_SPARK))
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in whole.schema]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, whole.collect())))
    pages = views.view(spark, DATA, "fragments").groupBy("doc_id", "page").count()
    assert executed(pages).count("Exchange hashpartitioning(doc_id") == 1
