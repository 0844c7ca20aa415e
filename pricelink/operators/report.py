"""Comparison, relations and ranking tables, and the price position of each member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, currency_text, normalize_key, step_colour, valid_price
from .numbering import ranked


def named_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters with display_name: the given name of a saved relation, else the shortest name of a member."""
    shortest = members.where("product_name <> ''").groupBy("cluster_id").agg(F.min(F.struct(F.length("product_name"), F.lower("product_name"), "product_name")).alias("_m"))
    given = F.when((F.col("source") == "manual") & (clean_text(F.col("given_name")) != ""), clean_text(F.col("given_name")))
    return clusters.join(shortest, "cluster_id", "left").withColumn("display_name", F.coalesce(given, "_m.product_name", F.lit("UNNAMED PRODUCT"))).drop("_m")


def keyed_clusters(named: DataFrame) -> DataFrame:
    """named clusters with product_key: the normalised name, or cluster_n for the n-th in the order of names. Names that
    normalise to nothing sort first, so only these are numbered."""
    key = normalize_key(F.col("display_name"))
    rows = named.withColumn("product_key", key)
    blank = ranked(rows.where("product_key = ''"), [], [F.col(c).asc() for c in ("phase", "ord", "sub")], "_place")
    return rows.where("product_key <> ''").unionByName(blank.withColumn("product_key", F.concat(F.lit("cluster_"), "_place")).drop("_place"))


def pivoted(members: DataFrame, stores: list[str]) -> DataFrame:
    return members.groupBy("cluster_id").pivot("store", stores).agg(F.first("price"))


def comparison(named: DataFrame, members: DataFrame, stores: list[str]) -> DataFrame:
    """product_key, Product and one price a store, for clusters with any price, in the order of Product."""
    priced = members.where("price > 0").select("cluster_id").distinct()
    wide = pivoted(members.join(priced, "cluster_id", "left_semi"), stores)
    return keyed_clusters(named).join(wide, "cluster_id").orderBy("display_name", "phase", "ord", "sub").select("product_key", F.col("display_name").alias("Product"), *[F.col(f"`{s}`") for s in stores])


def relations_wide(named: DataFrame, members: DataFrame, stores: list[str]) -> DataFrame:
    """Product, Match Source, and Product, Price and Score of each store, for all clusters."""
    wide = members.groupBy("cluster_id").pivot("store", stores).agg(F.first("product_name").alias("Product"), F.first("price").alias("Price"), F.round(F.first("score"), 4).alias("Score"))
    columns = [F.col(f"`{s}_{c}`").alias(f"{s} {c}") for s in stores for c in ("Product", "Price", "Score")]
    return named.join(wide, "cluster_id").orderBy("display_name", "phase", "ord", "sub").select(F.col("display_name").alias("Product"), F.col("source").alias("Match Source"), *columns)


def relation_rows(named: DataFrame, members: DataFrame, stores: list[str]) -> DataFrame:
    """product_name, source, and a map from store to its member (null where it has none)."""
    item = F.struct("product_key", "product_name", "price", "score", "source")
    found = members.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("store"), item))).alias("_m"))
    every = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.try_element_at("_m", F.lit(s))) for s in stores]))
    return named.join(found, "cluster_id").select(F.col("display_name").alias("product_name"), "source", every.alias("stores"))


def priced(members: DataFrame) -> DataFrame:
    """cluster_id, store, price, and the lowest and highest price of the cluster."""
    w = Window.partitionBy("cluster_id")
    rows = members.select("cluster_id", "store", valid_price(F.col("price")).alias("price")).where("price is not null")
    return rows.withColumn("low", F.min("price").over(w)).withColumn("high", F.max("price").over(w))


def is_best() -> Column:
    return F.abs(F.col("price") - F.col("low")) < 1e-9


def ranking(members: DataFrame, stores: list[str]) -> DataFrame:
    """Stores by the number of products for which they have the best price; ties count for all, and all stores are there."""
    counts = priced(members).where(is_best()).groupBy("store").agg(F.count(F.lit(1)).alias("n"))
    spark = members.sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in stores])).alias("store"))
    joined = every.join(counts, "store", "left")
    return joined.select(F.col("store").alias("Store"), F.coalesce("n", F.lit(0)).cast("long").alias("Products with best price")).orderBy(F.desc("Products with best price"), "Store")


def price_position(members: DataFrame) -> DataFrame:
    """cluster_id, store, price, ratio from lowest to highest, step of eleven, colour and is_best."""
    ratio = F.when(F.col("high") == F.col("low"), 0.0).otherwise((F.col("price") - F.col("low")) / (F.col("high") - F.col("low")))
    rows = priced(members).withColumn("ratio", ratio).withColumn("step", F.rint(F.col("ratio") * 10).cast("int"))
    return rows.select("cluster_id", "store", "price", "ratio", "step", step_colour(F.col("step")).alias("color"), is_best().alias("is_best"))


def search(table: DataFrame, query: str, column: str = "Product") -> DataFrame:
    """Rows whose normalised text holds the normalised query; all rows for a blank query."""
    wanted = normalize_key(F.lit(query))
    return table.where((wanted == "") | normalize_key(F.col(column)).contains(wanted))


def options(catalog: DataFrame) -> DataFrame:
    """Catalog items of each store in the order of their names."""
    order = [F.lower("product_name").asc(), F.col("product_key").asc()]
    return ranked(catalog.select("store", "product_key", "product_name"), ["store"], order, "place").withColumn("place", F.col("place").cast("int"))


def price_texts(selected: DataFrame, catalog: DataFrame) -> DataFrame:
    """Selected (store, product_key) with the price as a text, empty where there is none."""
    keys = selected.withColumn("product_key", clean_text(F.col("product_key")))
    return keys.join(catalog.select("store", "product_key", "price"), ["store", "product_key"], "left").withColumn("price_text", currency_text(F.col("price"))).drop("price")
