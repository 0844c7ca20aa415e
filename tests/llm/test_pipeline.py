import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    prose = [" ".join(f"word{(i * 7 + k * k) % 97} the of" for k in range(40)) for i in range(12)]
    texts = prose + [prose[0] + " ", prose[1].replace("the of", "the  of", 1), prose[2] + " odd", "12 34", None, ""]
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes[0] == 15 and sizes[1] == 13 and sizes[2] <= 13
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where(~F.col("decodes")).count() == 0 and out.count() == sizes[3]


def test_stages_take_no_rows_repeated_rows_and_other_columns(spark):
    prose = [" ".join(f"word{(i * 7 + k * k) % 97} the of" for k in range(40)) for i in range(3)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(prose)] * 3 + [(None, prose[0], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_size", F.lit(1)).withColumn("comp", F.lit("x")).withColumn("key", F.lit(2.0))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs.limit(0), "").count() == 0
    kept = corpus_pipeline.exact_dedup(spark, docs, "").cache()
    assert kept.columns == corpus_pipeline.COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1, 2]
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.where("source = 's'").count() >= 5
