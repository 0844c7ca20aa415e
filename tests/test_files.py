import pytest
from pyspark.sql import functions as F

from pricelink.operators import matching, relations
from pricelink.sources import files

MANUAL = "signature string, manual_ord long, product_name string, store_pos int, store string, ref string"


def test_saved_relations_round_trip(spark, tmp_path):
    rows = [("s1", 0, "Beef", 0, "A", "k1"), ("s1", 0, "Beef", 1, "B", 'k"2'), ("s2", 0, "", 0, "A", "k3")]
    files.write_saved(spark.createDataFrame(rows, MANUAL), str(tmp_path / "saved"))
    got = files.read_saved(spark, str(tmp_path / "saved")).collect()
    assert {(r["signature"], r["product_name"], r["store"], r["ref"]) for r in got} == {(s, n, st, k) for s, _, n, _, st, k in rows}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{nonsense")
    assert files.read_saved(spark, str(tmp_path / "bad")).count() == 0


def test_report_and_next_run(spark, tmp_path):
    listings = spark.createDataFrame([("A", 0, "k", "Beef 10", 1.0), ("B", 1, "k", "Beef 10", 2.0)], files.SCHEMAS["listings"])
    bundle = matching.compare(listings, ["A", "B"])
    files.write_report(bundle, str(tmp_path / "out"))
    assert files.read_part(spark, str(tmp_path / "out"), "Comparison").columns == ["Product", "A", "B"]
    sheet = files.read_relations(spark, str(tmp_path / "out"))
    manual = relations.relations_to_manual(sheet, ["A", "B"])
    again = matching.compare(listings, ["A", "B"], manual)
    assert [(r["Product"], r["Match Source"]) for r in again.relations().collect()] == [("Beef 10", "manual")]
    assert files.empty_template(spark).columns == ["COMMON NAME", "SYSCO", "KOHL", "US FOODS"]


def test_a_report_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, spare = str(tmp_path / "out"), spark.range
    part = lambda n: {name: spare(n) for name in ("Comparison", "Ranking", "Relations")}
    sizes = lambda: [files.read_part(spark, path, name).count() for name in part(0)]
    files.replace_parts(spark, path, part(3), "parquet")
    assert sizes() == [3, 3, 3]

    def dies(*_):
        raise OSError("killed")

    # before the pointer turns, and after it, before what is old is deleted
    for name, want in (("point_to", [3, 3, 3]), ("delete_parts", [5, 5, 5])):
        with monkeypatch.context() as m:
            m.setattr(files, name, dies)
            with pytest.raises(OSError):
                files.replace_parts(spark, path, part(5), "parquet")
        assert sizes() == want
    files.replace_parts(spark, path, {"Relations": spare(0)}, "parquet")
    assert sizes() == [5, 5, 0] and files.current_parts(spark, str(tmp_path / "none")) == {}


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_bad_lines_go_to_quarantine(spark, tmp_path, fmt):
    lines = {"json": ['{"doc_id": 1, "page": 2, "text": "a"}', "{broken", '{"doc_id": "x", "page": 1}', "{}"], "csv": ["doc_id,page,text", "1,2,a", "no number,1,b", ",,"]}
    (tmp_path / f"x.{fmt}").write_text("\n".join(lines[fmt]) + "\n")
    rows, bad = files.read_checked(spark, str(tmp_path / f"x.{fmt}"), "page_text", fmt)
    assert sorted((r["doc_id"] or 0, r["page"] or 0, r["text"] or "") for r in rows.collect()) == [(0, 0, ""), (1, 2, "a")]
    assert {r["raw"] for r in bad.collect()} == set(lines[fmt]) & {"{broken", '{"doc_id": "x", "page": 1}', "no number,1,b"}
    assert files.quarantine_counts(bad).first().asDict() == {"file": f"x.{fmt}", "n_bad": 2 if fmt == "json" else 1}


def test_saved_lines_round_trip_and_replace_their_signature_only(spark, tmp_path):
    path = str(tmp_path / "saved")
    many = spark.range(100_000).select(F.lit("s1").alias("signature"), F.col("id").alias("manual_ord"), F.concat(F.lit("n"), "id").alias("product_name"), F.lit(0).alias("store_pos"), F.lit("A").alias("store"), F.concat(F.lit('k"'), "id").alias("ref"))
    one = spark.createDataFrame([("s2", 7, "", 0, "B", "x"), ("s2", 7, "", 1, "A", " ")], MANUAL)
    files.write_saved_lines(many.unionByName(one), path)
    assert files.read_saved_lines(spark, path, "s1").drop("store_pos").exceptAll(many.drop("store_pos")).count() == 0 and files.read_saved_lines(spark, path, "s1").count() == 100_000
    files.write_saved_lines(one.withColumn("ref", F.lit("new")), path)
    assert files.read_saved_lines(spark, path).count() == 100_002
    assert {tuple(r) for r in files.read_saved_lines(spark, path, "s2").collect()} == {("s2", 7, "", 0, "A", "new"), ("s2", 7, "", 1, "B", "new")}
    (tmp_path / "saved/signature=s2/part-broken.txt").write_text("{nonsense\n")
    assert files.read_saved_lines(spark, path, "s2").count() == 2
