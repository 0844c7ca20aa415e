"""Catalogs: one long table (store, store_ord, product_key, product_name, price), one row a product of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, normalize_key


def cheapest(df: DataFrame, group: list[str]) -> DataFrame:
    """The row of each group and product_key with the lowest price (none is the highest), then the first name. A minimum
    of structs, so rows are combined before the shuffle."""
    pick = F.min(F.struct(F.col("price").isNull().alias("none"), "price", "product_name")).alias("_m")
    return df.groupBy(*group, "product_key").agg(pick).select(*group, "product_key", F.col("_m.product_name").alias("product_name"), F.col("_m.price").alias("price"))


def build_catalog(listings: DataFrame) -> DataFrame:
    """Clean keys (lower case) and names, prices as numbers; blank ones and prices of zero or less go, products without a
    price stay."""
    price = F.col("price").try_cast("double")
    rows = listings.where(F.col("product_key").isNotNull() & F.col("product_name").isNotNull()).select(
        "store", "store_ord", F.lower(clean_text(F.col("product_key"))).alias("product_key"), clean_text(F.col("product_name")).alias("product_name"),
        F.when(~F.isnan(price), price).alias("price"))
    rows = rows.where((F.col("product_key") != "") & (F.col("product_name") != "") & (F.col("price").isNull() | (F.col("price") > 0)))
    return cheapest(rows, ["store", "store_ord"])


def group_records(records: DataFrame) -> DataFrame:
    """doc_id, product_key, product_name, price: the cheapest record of each normalised name of a document."""
    rows = records.select("doc_id", normalize_key(clean_text(F.col("product_name"))).alias("product_key"), clean_text(F.col("product_name")).alias("product_name"), F.nanvl("price", F.lit(None).cast("double")).alias("price"))
    return cheapest(rows.where((F.col("product_key") != "") & (F.col("price").isNull() | (F.col("price") > 0))), ["doc_id"])


def name_lookup(catalog: DataFrame) -> DataFrame:
    """store, norm_name and the smallest product_key with that name."""
    rows = catalog.withColumn("norm_name", normalize_key(F.col("product_name"))).where("norm_name <> ''")
    return rows.groupBy("store", "norm_name").agg(F.min("product_key").alias("product_key"))
