"""Reading decoded price lists and saved relations, and writing reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.relations import DISPLAY, provider_mapping, relations_to_standard, store_frame
from .tables import staged

SCHEMAS = {
    "lists": "list_ord int, list_name string, path string",
    "fragments": "doc_id bigint, page int, page_height double, text string, x double, end_x double, y double",
    "table_rows": "doc_id bigint, page int, table_no int, row_no int, cells array<string>",
    "page_text": "doc_id bigint, page int, text string",
    "listings": "store string, store_ord int, product_key string, product_name string, price double",
}
SAVED = "version int, comparisons map<string, array<struct<product_name: string, stores: map<string, string>>>>"


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A decoded input table in Parquet, JSON or CSV, with its schema (no inference)."""
    return spark.read.format(fmt).schema(SCHEMAS[name]).option("header", "true").load(path)


CORRUPT = "_corrupt"


def read_checked(spark: SparkSession, path: str, name: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of an input table in JSON lines or CSV. Lines that do not fit the schema go to the quarantine (file,
    raw) instead of becoming rows of nulls or ending the run. What is read is written once, so both tables are of the same
    files."""
    schema = f"{SCHEMAS[name]}, {CORRUPT} string"
    read = spark.read.format(fmt).schema(schema).options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).load(path)
    rows = staged(read.select("*", F.col("_metadata.file_name").alias("_file")), "checked")
    good, bad = rows.where(F.col(CORRUPT).isNull()), rows.where(F.col(CORRUPT).isNotNull())
    return good.drop(CORRUPT, "_file"), bad.select(F.col("_file").alias("file"), F.col(CORRUPT).alias("raw"))


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    """file and n_bad, for the log of a run."""
    return quarantine.groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"))


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Saved relations from JSON files: signature, manual_ord, product_name, store_pos, store, ref. Malformed files give
    no rows."""
    return parse_saved(spark.read.text(path, wholetext=True))


def kept_refs(stores: Column) -> Column:
    """An array of (store, ref) of a map, cleaned, without blank ones."""
    pairs = F.transform(F.map_entries(stores), lambda e: F.struct(clean_text(e["key"]).alias("store"), clean_text(e["value"]).alias("ref")))
    return F.filter(pairs, lambda e: (e["store"] != "") & (e["ref"] != ""))


def parse_saved(texts: DataFrame, column: str = "value") -> DataFrame:
    found = texts.select(F.from_json(F.col(column), SAVED).alias("j")).select(F.explode("j.comparisons").alias("signature", "rows"))
    rows = found.select("signature", F.posexplode("rows").alias("manual_ord", "row")).where("row.stores is not null")
    kept = kept_refs(F.col("row.stores"))
    return rows.select("signature", "manual_ord", clean_text(F.col("row.product_name")).alias("product_name"), F.posexplode(kept).alias("store_pos", "e")).select("signature", "manual_ord", "product_name", "store_pos", "e.store", "e.ref")


def saved_json(manual: DataFrame) -> DataFrame:
    """signature and a JSON text of its saved relations."""
    row = manual.groupBy("signature", "manual_ord").agg(F.first("product_name").alias("product_name"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("store", "ref")))).alias("stores"))
    grouped = row.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("manual_ord", F.to_json(F.struct("product_name", "stores")).alias("j")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["j"]), ",")
    return grouped.select("signature", F.concat(F.lit('{"version":1,"comparisons":{'), F.to_json(F.struct(F.col("signature").alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("signature").alias("s")))) - 6), F.lit(":["), body, F.lit("]}}")).alias("value"))


def write_saved(manual: DataFrame, path: str) -> None:
    """One JSON line a signature, in folders by signature."""
    saved_json(manual).write.mode("overwrite").partitionBy("signature").text(path)


LINE = "product_name string, stores map<string, string>"


def write_saved_lines(manual: DataFrame, path: str) -> None:
    """Saved relations (signature, manual_ord, product_name, store, ref) as one JSON line each, in folders by signature; no value
    holds more than one relation. Signatures among the rows replace their own folder, others stay."""
    row = manual.groupBy("signature", "manual_ord").agg(F.first("product_name").alias("product_name"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("store", "ref")))).alias("stores"))
    lines = row.select("signature", F.to_json(F.struct("manual_ord", "product_name", "stores")).alias("value"))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signature").text(path)


def read_saved_lines(spark: SparkSession, path: str, signature: str | None = None) -> DataFrame:
    """What `write_saved_lines` wrote, of one signature or of all; a malformed line gives no row."""
    lines = spark.read.schema("value string, signature string").text(path)
    if signature is not None:
        lines = lines.where(F.col("signature") == signature)
    rows = lines.select("signature", F.from_json("value", f"manual_ord long, {LINE}").alias("j")).where("j.manual_ord is not null and j.stores is not null")
    return rows.select("signature", "j.manual_ord", clean_text(F.col("j.product_name")).alias("product_name"), F.posexplode(kept_refs(F.col("j.stores"))).alias("store_pos", "e")).select("signature", "manual_ord", "product_name", "store_pos", "e.store", "e.ref")


POINTER = "CURRENT"


def current_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each part of a report, by its pointer; none where there is no report yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/{POINTER}", wholetext=True).collect()))


def point_to(spark: SparkSession, path: str, parts: dict[str, str]) -> None:
    """Let the pointer of a report name these folders. The new pointer is written beside the old one and takes its place in
    one rename, so a reader finds the old report or the new one, whenever a run dies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, target = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"_pointer-{uuid.uuid4().hex}", POINTER))
    out = fresh.getFileSystem(conf).create(fresh)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, target, options)


def delete_parts(spark: SparkSession, path: str, parts: list[str]) -> None:
    for part in parts:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def replace_parts(spark: SparkSession, path: str, parts: dict[str, DataFrame], fmt: str) -> None:
    """Write parts of a report into folders of their own, then point to them; what they replace is deleted last."""
    run, before = uuid.uuid4().hex, current_parts(spark, path)
    for name, df in parts.items():
        df.write.format(fmt).option("header", "true").save(f"{path}/{name}-{run}")
    point_to(spark, path, before | {name: f"{name}-{run}" for name in parts})
    delete_parts(spark, path, [before[name] for name in parts if name in before])


def with_row_ord(sheet: DataFrame) -> DataFrame:
    """A sheet with row_ord, which keeps its order in files."""
    return sheet.select(F.monotonically_increasing_id().alias("row_ord"), "*")


def write_report(bundle, path: str, fmt: str = "parquet", standard: DataFrame | None = None) -> None:
    """Comparison (without product_key), Ranking and Relations (in the standard layout, with row_ord), in folders under one
    path that its pointer names. All are written before the pointer turns from an earlier report to them."""
    spark = bundle.members.sparkSession
    if standard is None:
        mapping = {r["store"]: r["provider"] for r in provider_mapping(store_frame(spark, bundle.stores)).collect()}
        standard = relations_to_standard(bundle.relations(), mapping)
    parts = {"Comparison": bundle.comparison().drop("product_key"), "Ranking": bundle.ranking(), "Relations": with_row_ord(standard)}
    replace_parts(spark, path, parts, fmt)


def replace_relations(standard: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace only the relations of a report; a table without rows replaces them too."""
    replace_parts(standard.sparkSession, path, {"Relations": with_row_ord(standard)}, fmt)


def read_part(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A part of the report that the pointer names: Comparison, Ranking or Relations."""
    return spark.read.format(fmt).option("header", "true").load(f"{path}/{current_parts(spark, path)[name]}")


def read_relations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The relations of a report, a sheet with row_ord."""
    return read_part(spark, path, "Relations", fmt).withColumn("row_ord", F.col("row_ord").cast("long"))


def empty_template(spark: SparkSession) -> DataFrame:
    """A relations sheet without rows, under the headers of an export."""
    return spark.createDataFrame([], ", ".join(f"`{d}` string" for d in DISPLAY.values()))
