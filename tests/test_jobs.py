import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricelink.operators import intake, matching, numbering, relations
from pricelink.plans import jobs
from pricelink.sources import files

LISTS = "list_ord int, list_name string, path string, doc_id long"


def inputs(spark):
    """Three lists of text lines and one without products."""
    names = ["Beef Loin 10 CT", "Fresh Salmon Fillet 5 CT", "Pork Ribs 8 CT", "Camaron Grande 4 CT"]
    other = ["Loin Beef 10 CT", "Salmon Fillet Fresh 5 CT", "Ribs Pork 8 CT", "Oat Milk 2 CT"]
    line = lambda i, n, p: f"{10000 + i} 1 10 LB Brand {n} $ {p} CS"
    pages = [(d, 1, "\n".join(line(i, n, 3 + i + d) for i, n in enumerate(each))) for d, each in ((0, names), (1, other), (2, names[:2]))]
    lists = [(0, "Sysco", "a.pdf", 0), (1, "", "us foods b.PDF", 1), (2, "Sysco", "c.pdf", 2), (3, "bad", "d.pdf", 3), (4, "again", "a.pdf", 4), (5, "text", "e.txt", 5)]
    return (
        spark.createDataFrame(lists, LISTS),
        spark.createDataFrame([], files.SCHEMAS["fragments"]),
        spark.createDataFrame([], files.SCHEMAS["table_rows"]),
        spark.createDataFrame(pages, files.SCHEMAS["page_text"]),
    )


def test_job_writes_a_report_and_the_next_run_starts_from_it(spark, tmp_path):
    given, out = inputs(spark), str(tmp_path / "out")
    summary = jobs.run(out, *given).first()
    assert (summary["ok"], summary["store_count"]) == (True, 4) and summary["product_count"] >= 4
    job = jobs.compare_lists(*given)
    assert job.counts.first().asDict() == {"added": 4, "skipped": 2}
    log = {r["store"]: (r["product_count"], r["source_format"], r["status"]) for r in job.log.collect()}
    assert log == {"Sysco": (4, "single-column", "ok"), "US FOOD": (4, "single-column", "ok"), "Sysco_2": (2, "single-column", "ok"), "bad": (0, None, "failed")}
    written = files.read_relations(spark, out)
    assert written.columns == ["row_ord", *relations.STANDARD_COLUMNS]
    manual = jobs.saved_relations(["Sysco", "US FOOD", "Sysco_2"], report=written)
    assert manual.select("manual_ord").distinct().count() >= 2
    again = jobs.compare_lists(*given, manual=manual)
    before = {tuple(sorted((r["store"], r["product_key"]) for r in g)) for g in groups(job.bundle)}
    after = {tuple(sorted((r["store"], r["product_key"]) for r in g)) for g in groups(again.bundle)}
    assert before == after
    assert again.bundle.clusters.where("source = 'manual'").count() == manual.select("manual_ord").distinct().count()


def test_saved_relations_of_one_signature_are_taken_and_written_back(spark, tmp_path):
    row = "signature string, manual_ord long, product_name string, store_pos int, store string, ref string"
    saved = spark.createDataFrame([(s, 0, f"of {s}", i, st, f"{s}{i}") for s in ("s1", "s2") for i, st in enumerate("xy")], row)
    got = jobs.saved_relations(["x", "y"], saved=saved, signature="s2").collect()
    assert {(r["product_name"], r["store"], r["ref"]) for r in got} == {("of s2", "x", "s20"), ("of s2", "y", "s21")}
    with pytest.raises(ValueError):
        jobs.saved_relations(["x", "y"], saved=saved)
    stores = spark.createDataFrame([("North", "a.pdf"), ("south ", "B.pdf")], "store string, path string")
    signature = jobs.run_signature(stores)
    assert signature == hashlib.sha1(b"NORTH|a.pdf\nSOUTH|b.pdf").hexdigest()
    path = str(tmp_path / "saved")
    files.write_saved_lines(saved, path)
    jobs.save_back(path, saved.where("signature = 's1'"), signature)
    assert files.read_saved_lines(spark, path).groupBy("signature").count().count() == 3
    again = jobs.saved_relations(["x", "y"], saved=files.read_saved_lines(spark, path), signature=signature)
    assert {r["ref"] for r in again.collect()} == {"s10", "s11"}


def test_one_list_that_cannot_be_read_does_not_stop_the_others(spark, tmp_path):
    lists, fragments, rows, pages = inputs(spark)
    lists = lists.union(spark.createDataFrame([(6, " ", "kohls 6.pdf", 6)], LISTS))
    more = pages.union(pages.where("doc_id = 1").withColumn("doc_id", F.lit(6).cast("long")))
    broken = more.withColumn("text", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("no text in b"))).otherwise(F.col("text")))
    job = jobs.compare_lists(lists, fragments, rows, broken)
    log = {r["store"]: (r["product_count"], r["status"], r["error"]) for r in job.log.collect()}
    assert {s: x[:2] for s, x in log.items()} == {"Sysco": (4, "ok"), "US FOOD": (0, "failed"), "Sysco_2": (2, "ok"), "bad": (0, "failed"), "KOHL": (4, "ok")}
    assert "no text in b" in log["US FOOD"][2] and all(log[s][2] is None for s in ("Sysco", "Sysco_2", "bad", "KOHL"))
    assert job.bundle.stores == ["Sysco", "Sysco_2", "KOHL"] and job.summary.first()["store_count"] == 5


def test_a_damaged_file_is_its_lists_fault_and_damage_to_all_the_storages(spark, tmp_path):
    lists, fragments, rows, pages = inputs(spark)
    few, path = lists.where("doc_id in (0, 1)"), tmp_path / "pages"
    pages.write.partitionBy("doc_id").parquet(str(path))
    read = lambda: spark.read.schema(pages.schema).parquet(str(path))
    for doc, found in ((1, {0}), (0, None)):
        for file in (path / f"doc_id={doc}").glob("*.parquet"):
            file.write_bytes(b"PAR1 not a table PAR1")
        if found:
            stores, listings = jobs.listings_of(few, fragments, rows, read())
            assert {r["store_ord"] for r in listings.select("store_ord").collect()} == found
            assert [(r["store"], "FAILED_READ_FILE" in (r["error"] or "")) for r in stores.orderBy("store_ord").collect()] == [("Sysco", False), ("US FOOD", True)]
        else:
            with pytest.raises(Exception, match="FAILED_READ_FILE"):
                jobs.listings_of(few, fragments, rows, read())


def test_blank_names_are_the_providers(spark):
    lists = spark.createDataFrame([(0, " ", "a.pdf", 0), (1, "", "b.pdf", 1), (2, "Own", "sysco.pdf", 2), (3, None, "c.pdf", 3)], LISTS)
    pages = spark.createDataFrame([(3, 3, "kohl"), (3, 2, "US FOODS list"), (1, 1, None)], files.SCHEMAS["page_text"])
    assert [r["list_name"] for r in intake.named_by_provider(lists, pages).orderBy("list_ord").collect()] == ["SYSCO", intake.ASK, "Own", "US FOOD"]
    own = spark.createDataFrame([(0, "Own", "a.pdf", 0), (1, "", "b.pdf", 1), (2, "sysco ", "c.pdf", 2), (3, "", "d.pdf", 3)], LISTS)
    assert [r["list_name"] for r in intake.named_by_provider(own, pages.limit(0)).orderBy("list_ord").collect()] == ["Own", "SYSCO", "sysco", intake.ASK]


def test_reports_have_names(spark):
    assert jobs.output_path(spark, "/x/", "  may  2024 ") == "/x/may 2024" and jobs.output_path(spark, "/x") == "/x/price_comparison"


def test_what_the_storage_raises_is_not_a_summary(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere|PATH_NOT_FOUND|exist"):
        lists, fragments, rows, pages = inputs(spark)
        missing = spark.read.schema(pages.schema).parquet(str(tmp_path / "nowhere"))
        jobs.run(str(tmp_path / "out"), lists, fragments, rows, missing)


def groups(bundle):
    found = {}
    for r in bundle.members.collect():
        found.setdefault(r["cluster_id"], []).append(r)
    return found.values()


def test_failed_runs_say_so_and_keep_the_report(spark, tmp_path):
    lists, fragments, rows, pages = inputs(spark)
    out = str(tmp_path / "out")
    assert jobs.run(out, lists, fragments, rows, pages).first()["ok"]
    kept = files.read_relations(spark, out).count()
    failed = jobs.run(out, lists, fragments, rows, pages.limit(0)).first()
    assert not failed["ok"] and failed["product_count"] == 0 and "valid product" in failed["error"]
    assert files.read_relations(spark, out).count() == kept
    files.replace_relations(files.read_relations(spark, out).drop("row_ord").limit(0), out)
    assert files.read_relations(spark, out).count() == 0


def test_sources_of_saved_relations_are_merged_in_order(spark):
    row = "manual_ord long, product_name string, store_pos int, store string, ref string"
    a = spark.createDataFrame([(0, "A", 1, "y", "k1"), (0, "A", 0, "x", "k2"), (1, "alone", 0, "x", "k3")], row)
    b = spark.createDataFrame([(0, "B", 0, "x", "k2"), (0, "B", 1, "y", " k1 "), (2, "C", 0, "y", "k4"), (2, "C", 1, "x", "k5")], row)
    got = relations.as_manual(relations.merge_manual([(0, a), (1, b)])).orderBy("manual_ord", "store_pos").collect()
    assert [tuple(r)[1:] for r in got] == [("A", 0, "x", "k2"), ("A", 1, "y", "k1"), ("C", 0, "y", "k4"), ("C", 1, "x", "k5")]
    assert len({r["manual_ord"] for r in got}) == 2 and got[0]["manual_ord"] < got[2]["manual_ord"]


def test_standard_sheets_come_back_unchanged(spark):
    sheet = spark.createDataFrame([(0, "P", "a", "b", ""), (1, "Q", "", "c", "d"), (2, "", "e", "", "f")], "row_ord long, nombre_producto string, nombre_sysco string, nombre_kohl string, nombre_usfood string")
    manual = relations.relations_to_manual(sheet, ["Kohl", "Sysco", "US Foods"])
    mapping = relations.provider_mapping(relations.store_frame(spark, ["Kohl", "Sysco", "US Foods"]))
    back = relations.manual_to_standard(manual, mapping).orderBy("manual_ord").drop("manual_ord").collect()
    assert [tuple(r) for r in back] == [("P", "a", "b", ""), ("Q", "", "c", "d"), ("e", "e", "", "f")]


def test_every_item_is_in_one_cluster_whatever_the_order_of_rows(spark):
    r = random.Random(3)
    words = ["beef", "pork", "loin", "fresh", "ribs", "salmon", "milk"]
    rows = [(s, o, f"{n} {o}".lower(), n, float(1 + i)) for o, s in enumerate("ABC") for i in range(15) for n in [" ".join(r.sample(words, 3)) + f" {r.randint(1, 4)} CT"]]
    bundles = []
    for _ in range(2):
        r.shuffle(rows)
        bundles.append(matching.compare(spark.createDataFrame(rows, files.SCHEMAS["listings"]).repartition(r.randint(1, 5)), ["A", "B", "C"]))
    found = [sorted((m["store"], m["product_key"], m["cluster_id"]) for m in b.members.collect()) for b in bundles]
    assert found[0] == found[1] and len({x[:2] for x in found[0]}) == len(found[0]) == len({(x[1], x[0]) for x in rows and [(m[0], m[2]) for m in rows]})
    assert max(map(len, groups(bundles[0]))) <= 3


def test_large_cross_joins_are_refused(spark):
    from pricelink.functions.features import with_features

    names = with_features(spark.createDataFrame([("a b 1",), ("c d 2",)], "product_name string")).withColumn("cluster_id", F.lit("x"))
    with pytest.raises(ValueError):
        matching.all_pairs(names, names, 3)
    with pytest.warns(UserWarning):
        assert matching.all_pairs(names, names).count() == 4


@pytest.mark.parametrize("ranges", [1, 3, 100])
def test_numbers_over_ranges(spark, ranges):
    values = random.Random(1).sample(range(-50, 10**6), 200)
    got = numbering.with_numbers(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n", ranges).collect()
    assert {r["v"]: r["n"] for r in got} == {v: i + 1 for i, v in enumerate(sorted(values))}
    assert numbering.with_numbers(spark.createDataFrame([], "v long"), "v", "n").count() == 0
