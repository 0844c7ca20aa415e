"""A training corpus from documents, stage by stage: language ID, exact dedup, near-dedup, source mixing, BPE tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that
is written and read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelink.llm import bpe, dedup, langid, mixing, simhash
from pricelink.llm.common import written
from pricelink.llm.queries import tokenizer_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Of two texts whose runs of five words have a Jaccard similarity of 0.8 (a cosine of 0.89), 39 of 256 bits differ on
#: average, with a standard deviation of 6.
NEAR_BITS = 48


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter, which are in no language. A text split evenly over several languages stays, and
    where no document has a label to learn from, all stay."""
    model = langid.train(docs)
    if not model.langs:
        return docs.select(*COLUMNS)
    return langid.identified(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return dedup.without_copies(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one stays: runs of five words and a similarity of 0.8 or more, which is a
    distance of NEAR_BITS in 256 bits."""
    return simhash.first_of_each(docs, NEAR_BITS).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row for each pass that the mix takes over them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids and their count, and proves that they decode to the text."""
    files = tokenizer_files()
    found = bpe.decode(bpe.encode(docs, **files), **files)
    return found.select(*COLUMNS, "n_tokens", "ids", (F.col("decoded") == F.col("text").cast("binary")).alias("decodes"))


STAGES = [("language ID", language), ("exact dedup", exact_dedup), ("near-dedup", near_dedup), ("source mixing", mix), ("BPE tokens", tokenize)]

#: Trained models, XXH64 and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
