"""The queries on price lists: one for each operator, on views of the star schema, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import similarity, text
from ..operators import catalog, intake, layout, matching, relations, report, tables
from ..sources import files
from ..sources.tables import shared_path, staged
from ..sources.views import STORES, duckdb_sql, view
from . import jobs, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if name in sql.SQL:
            ORACLE_SQL[name] = duckdb_sql(sql.SQL[name])
        return f

    return add


def on(name: str, *views: str):
    """A query whose function takes views."""

    def add(f):
        query(name)(lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views]))
        return f

    return add


# text and number rules


@on("clean_text", "documents")
def _(docs):
    return docs.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@on("normalize_key", "documents")
def _(docs):
    return docs.select("doc_id", text.normalize_key(F.col("text")).alias("norm"))


@on("to_numeric", "lineitem")
def _(rows):
    raw = F.concat(F.lit("$ "), F.format_number("l_extendedprice", 2), F.lit(" "), F.col("l_returnflag"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.to_numeric(raw).alias("amount"))


@on("price_candidate", "fragments")
def _(rows):
    found = text.price_candidate(F.col("text"))
    return rows.select("doc_id", "text", "x", "y", found["price"].alias("price"), found["unit"].alias("unit"))


@on("single_line_parse", "page_text")
def _(rows):
    found = text.list_line(F.col("text"))
    return rows.select("doc_id", "page", "text", found["product_name"].alias("product_name"), found["price"].alias("price"))


@on("provider_detect", "documents")
def _(docs):
    return docs.select("doc_id", text.detect_provider(F.concat_ws(" ", "source", F.when(F.col("doc_id") % 3 == 0, "US  Foods").when(F.col("doc_id") % 3 == 1, "KOHL's"), "text")).alias("provider"))


@on("relation_value", "standard_sheet")
def _(rows):
    return rows.select("row_ord", *[text.relation_value(F.col(c)).alias(c) for c in rows.columns[1:]])


@on("product_id", "documents")
def _(docs):
    return docs.select("doc_id", text.product_id(F.col("text")).alias("product_id"))


@on("header_predicates", "part")
def _(rows):
    head = F.when(F.col("p_size") % 4 == 0, "Item Description").when(F.col("p_size") % 4 == 1, F.concat(F.lit("Unit Cost "), F.col("p_brand"))).when(F.col("p_size") % 4 == 2, F.concat(F.col("p_name"), F.lit(" product-name"))).otherwise(F.col("p_name"))
    return rows.select("p_partkey", text.is_product_header(head).alias("product_header"), text.is_price_header(head).alias("price_header"))


@on("valid_price", "lineitem")
def _(rows):
    x = F.when(F.col("l_linenumber") == 1, F.lit("NaN").cast("double")).when(F.col("l_linenumber") == 2, F.lit("Infinity").cast("double")).otherwise(F.col("l_extendedprice") - 20000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.valid_price(x).alias("price"))


# intake


@on("intake_filter", "lists")
def _(lists):
    return intake.with_status(lists).select("list_ord", "path", "status")


@on("default_names", "lists")
def _(lists):
    return lists.select("list_ord", intake.default_name(F.col("list_name"), F.col("list_ord") + 1).alias("store"))


@on("unique_names", "lists")
def _(lists):
    return intake.unique_names(lists).select("list_ord", "unique_name")


@on("provider_detect_doc", "lists", "list_pages")
def _(lists, pages):
    return intake.detect_list_provider(lists, pages).select("list_ord", "provider")


@on("suggest_names", "lists", "list_pages")
def _(lists, pages):
    return intake.suggested_names(intake.detect_list_provider(lists, pages)).select("list_ord", "suggested")


@on("store_names", "lists", "list_pages")
def _(lists, pages):
    accepted = intake.with_status(lists).where("status = 'added'")
    return intake.unique_names(intake.named_by_provider(accepted, pages)).select("list_ord", "unique_name")


@on("output_names", "part")
def _(rows):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(".XLSX"))).when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return rows.select("p_partkey", intake.output_name(name).alias("output"))


@on("signature", "lists")
def _(lists):
    runs = lists.withColumn("run", F.col("list_ord") % 5)
    return intake.signatures(runs, ["run"])


@on("ingestion_log", "listings", "lists")
def _(listings, lists):
    stores = lists.select(F.upper(text.clean_text(F.col("list_name"))).alias("store"))
    return intake.ingestion_log(stores, catalog.build_catalog(listings))


@on("run_summary", "same_listings")
def _(listings):
    cat = catalog.build_catalog(listings)
    log = intake.ingestion_log(listings.select("store"), cat)
    return intake.run_summary(log, cat.where("price > 0").select("product_key").distinct())


# features and similarity


@on("features", "listings")
def _(listings):
    return feat.with_features(listings.select("product_name").distinct()).select("product_name", "canonical_text", *[F.array_join(F.array_sort(c), " ").alias(c) for c in feat.FEATURES[1:]])


@on("features_legacy", "listings")
def _(listings):
    return feat.with_features(listings.select("product_name").distinct(), legacy=True).select("product_name", "canonical_text", *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("strong", "numbers")])


@on("state_conflict", "part")
def _(rows):
    states = F.array(F.lit("fresh"), F.lit("frozen"), F.lit("canned"))
    a, b = F.array(F.get(states, F.col("p_size") % 3)), F.array(F.get(states, (F.col("p_partkey") % 3).cast("int")))
    return rows.select("p_partkey", feat.state_conflict(a, b).alias("conflict"))


#: The names of one store that share a number are dealt to so many tasks.
DEALT = 8


def overlapping(listings: DataFrame, **more: Column) -> DataFrame:
    """Pairs of SYSCO and KOHL names with the same number token; `more`: columns of one name (a_... or b_...), made before names
    meet. Few names make many pairs, so the names of a number are dealt to several tasks, whose number does not go by bytes."""
    names = feat.with_features(listings.select("store", "product_name").distinct())
    n_tasks = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(store: str, p: str, salt: Column) -> DataFrame:
        given = names.where(F.col("store") == store).select(F.col("product_name").alias(f"{p}_name"), *[F.col(c).alias(f"{p}_{c}") for c in feat.FEATURES])
        given = given.withColumns({k: v for k, v in more.items() if k.startswith(f"{p}_")})
        return given.withColumn("_n", F.explode(f"{p}_numbers")).withColumn("_salt", salt).repartition(n_tasks, "_n", "_salt")

    a, b = side("SYSCO", "a", F.pmod(F.xxhash64("a_name"), F.lit(DEALT)).cast("int")), side("KOHL", "b", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return a.join(b, ["_n", "_salt"]).drop("_n", "_salt")


@on("token_overlap", "listings")
def _(listings):
    a, b = F.col("a_tokens"), F.col("b_tokens")
    strong = feat.strong_overlap(F.col("a_strong"), F.col("b_strong"))
    return overlapping(listings).select("a_name", "b_name", feat.jaccard(a, b).alias("jaccard"), feat.containment(a, b).alias("containment"), strong.alias("strong_overlap"))


@on("sequence_ratio", "listings")
def _(listings):
    return overlapping(listings).select("a_name", "b_name", similarity.text_ratio(F.col("a_canonical_text"), F.col("b_canonical_text")).alias("ratio"))


@on("lcs_ratio", "listings")
def _(listings):
    a, b = F.col("a_canonical_text"), F.col("b_canonical_text")
    pairs = overlapping(listings, a_masks=similarity.lcs_masks(a), b_codes=similarity.lcs_codes(b))
    return pairs.select("a_name", "b_name", similarity.lcs_ratio(a, b, F.col("a_masks"), F.col("b_codes")).alias("ratio"))


@on("similarity", "listings")
def _(listings):
    return similarity.score_pairs(overlapping(listings)).select("a_name", "b_name", "score")


@on("similarity_legacy", "listings")
def _(listings):
    return similarity.score_pairs(overlapping(listings), "legacy").select("a_name", "b_name", "score")


# records from pages


@on("line_groups", "fragments")
def _(rows):
    return layout.page_lines(rows).groupBy("doc_id", "page", "line_no", "line_y").agg(F.count(F.lit(1)).alias("n_fragments"))


@on("line_cells", "fragments")
def _(rows):
    return layout.page_cells(rows).select("doc_id", "page", "line_y", "text", "x", "end_x")


@on("line_text", "fragments")
def _(rows):
    return layout.page_texts(rows).select("doc_id", "page", "line_y", "text")


@on("header_pair", "fragments")
def _(rows):
    return layout.found_pairs(rows).select("doc_id", "page", "p_x", "p_end", "p_y", "r_x", "r_y", "score")


@on("column_bounds", "fragments")
def _(rows):
    return layout.found_bounds(layout.line_table(rows))


@on("price_rows", "fragments")
def _(rows):
    return layout.found_rows(layout.line_table(rows))[1].select("doc_id", "page", "y", "price", "unit")


@on("row_window", "fragments")
def _(rows):
    return layout.row_windows(layout.found_rows(layout.line_table(rows))[1])


@on("row_text", "fragments")
def _(rows):
    return layout.positioned_raw(rows).drop("rec_ord")


@on("positioned", "fragments")
def _(rows):
    return layout.positioned_records(rows)


@on("case_prices", "records")
def _(rows):
    return layout.prefer_case_prices(rows)


@on("disambiguate", "records")
def _(rows):
    return layout.disambiguate(rows)


@on("group_records", "records")
def _(rows):
    return catalog.group_records(rows)


# records from tables and lines


@on("table_normalize", "table_rows")
def _(rows):
    return tables.normalize_rows(rows).select("doc_id", "row_no", F.array_join("cells", "|").alias("cells"))


@on("table_header", "table_rows")
def _(rows):
    return tables.header_names(tables.with_header(rows))


@on("table_body", "table_rows")
def _(rows):
    return tables.body_rows(tables.with_header(rows)).select("doc_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@on("table_columns", "table_rows")
def _(rows):
    return tables.detected_columns(tables.header_names(tables.with_header(rows)))


@on("table_extract", "table_rows")
def _(rows):
    return tables.tabular_records(rows)


@on("single_column", "table_rows", "page_text")
def _(rows, pages):
    return tables.single_column_records(rows, pages)


@on("single_column_all_pages", "table_rows", "page_text")
def _(rows, pages):
    return tables.single_column_records(rows, pages, all_pages=True)


@on("parse_cascade", "fragments", "cascade_rows", "cascade_text")
def _(fragments, rows, pages):
    return layout.parse_listings(fragments, rows, pages)


# catalog and matching


@on("catalog", "listings")
def _(listings):
    return catalog.build_catalog(listings)


@on("lookup_name", "listings")
def _(listings):
    return catalog.name_lookup(catalog.build_catalog(listings))


@on("manual_resolve", "same_listings", "manual_rows")
def _(listings, manual):
    return matching.resolve_manual(catalog.build_catalog(listings), manual).drop("product_name")


@on("manual_claim", "same_listings", "manual_rows")
def _(listings, manual):
    return matching.claim_manual(catalog.build_catalog(listings), manual)[1]


@on("remaining", "same_listings", "manual_rows")
def _(listings, manual):
    cat = catalog.build_catalog(listings)
    return matching.remaining(cat, matching.claim_manual(cat, manual)[1]).select("store", "product_key", "price")


@on("exact_key_match", "same_listings")
def _(listings):
    cat = catalog.build_catalog(listings)
    members = cat.where("store = 'SYSCO'").select("product_key", F.concat(F.lit("s0:"), "product_key").alias("cluster_id"), F.lit(1).alias("phase"), F.lit(0).cast("long").alias("ord"), F.col("product_key").alias("sub"))
    return matching.same_key(cat.where("store = 'KOHL'"), members)


def exact_clusters(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and members of listings whose keys match exactly."""
    cat = catalog.build_catalog(listings)
    members = cat.select(F.col("product_key").alias("cluster_id"), "store", "product_key", "product_name", "price", F.lit(1.0).alias("score"), F.lit("auto").alias("source"))
    opener = cat.groupBy("product_key").agg(F.min("store_ord").cast("long").alias("ord"))
    return opener.select(F.col("product_key").alias("cluster_id"), F.lit(1).alias("phase"), "ord", F.col("product_key").alias("sub"), F.lit("auto").alias("source"), F.lit(None).cast("string").alias("given_name")), members


@on("display_name", "listings")
def _(listings):
    names = listings.select("store", "product_name", F.split("product_name", " ")[0].alias("cluster_id")).distinct()
    clusters = names.select("cluster_id", F.lit("auto").alias("source"), F.lit("").alias("given_name")).distinct()
    return report.named_clusters(clusters, names).select("cluster_id", "display_name")


@on("comparison_exact", "same_listings")
def _(listings):
    clusters, members = exact_clusters(listings)
    return report.comparison(report.named_clusters(clusters, members), members, STORES)


@on("relations_wide", "same_listings")
def _(listings):
    clusters, members = exact_clusters(listings)
    return report.relations_wide(report.named_clusters(clusters, members), members, STORES)


@on("ranking", "same_listings")
def _(listings):
    return report.ranking(exact_clusters(listings)[1], STORES)


@on("price_position", "same_listings")
def _(listings):
    return report.price_position(exact_clusters(listings)[1])


@on("best_flag", "same_listings")
def _(listings):
    return report.price_position(exact_clusters(listings)[1]).where("is_best").select("cluster_id", "store", "price")


@on("search", "documents")
def _(docs):
    return report.search(docs.select("doc_id", "text"), "  Of THE ", "text").select("doc_id")


@on("options_sorted", "listings")
def _(listings):
    return report.options(catalog.build_catalog(listings))


@on("editor_price", "same_listings", "manual_rows")
def _(listings, manual):
    return report.price_texts(manual.select("manual_ord", "store", F.col("ref").alias("product_key")), catalog.build_catalog(listings))


def fuzzy(listings: DataFrame, **how) -> matching.Bundle:
    return matching.compare(listings, STORES, **how)


@on("best_candidates", "listings")
def _(listings):
    names = feat.with_features(catalog.build_catalog(listings))
    order = {"cluster_id": F.concat(F.lit("s0:"), "product_key"), "phase": F.lit(1), "ord": F.lit(0).cast("long"), "sub": F.col("product_key")}
    return matching.best_candidates(names.where("store = 'KOHL'"), names.where("store = 'SYSCO'").withColumns(order))


@on("assignment", "listings")
def _(listings):
    names = feat.with_features(catalog.build_catalog(listings))
    order = {"cluster_id": F.concat(F.lit("s0:"), "product_key"), "phase": F.lit(1), "ord": F.lit(0).cast("long"), "sub": F.col("product_key")}
    return matching.assign(matching.best_candidates(names.where("store = 'US FOOD'"), names.where("store = 'SYSCO'").withColumns(order)))


@on("comparison_fuzzy", "listings")
def _(listings):
    return fuzzy(listings).comparison()


@on("comparison_manual", "listings", "manual_rows")
def _(listings, manual):
    return fuzzy(listings, manual=manual).comparison()


@on("comparison_legacy", "listings")
def _(listings):
    return fuzzy(listings, scorer="legacy", ratio="lcs").comparison()


@on("ranking_fuzzy", "listings")
def _(listings):
    return fuzzy(listings).ranking()


@on("relations_fuzzy", "listings")
def _(listings):
    return fuzzy(listings).relations()


def sysco_and(listings: DataFrame, store: str) -> tuple[DataFrame, DataFrame]:
    """A store's items, and SYSCO's as members of clusters, with features."""
    names = feat.with_features(catalog.build_catalog(listings))
    order = {"cluster_id": F.concat(F.lit("s0:"), "product_key"), "phase": F.lit(1), "ord": F.lit(0).cast("long"), "sub": F.col("product_key")}
    return names.where(F.col("store") == store), names.where("store = 'SYSCO'").withColumns(order)


@on("best_candidates_equal", "listings")
def _(listings):
    return matching.best_candidates(*sysco_and(listings, "KOHL"), ratio=similarity.EQUAL)


@on("assignment_equal", "listings")
def _(listings):
    return matching.assign(matching.best_candidates(*sysco_and(listings, "US FOOD"), ratio=similarity.EQUAL))


@on("comparison_equal", "listings")
def _(listings):
    return fuzzy(listings, ratio=similarity.EQUAL).comparison()


@on("ranking_equal", "listings")
def _(listings):
    return fuzzy(listings, ratio=similarity.EQUAL).ranking()


@on("relations_equal", "listings")
def _(listings):
    return fuzzy(listings, ratio=similarity.EQUAL).relations()


@on("job_comparison", "few_lists", "few_fragments", "few_rows", "few_text")
def _(*inputs):
    return jobs.compare_lists(*inputs).bundle.comparison()


@on("job_log", "many_lists", "many_fragments", "many_rows", "many_text")
def _(*inputs):
    return intake.ingestion_log(*jobs.listings_of(*inputs)).drop("error")


def named_pairs(pairs: DataFrame, legacy: bool) -> DataFrame:
    """Pairs of names (a_name, b_name) with the features of both. The pairs are read three times, so they are written."""
    pairs = staged(pairs, "pairs")
    names = pairs.select(F.col("a_name").alias("product_name")).union(pairs.select("b_name")).distinct()
    known = feat.with_features(names, legacy=legacy)
    for p in "ab":
        pairs = pairs.join(known.select(F.col("product_name").alias(f"{p}_name"), *[F.col(c).alias(f"{p}_{c}") for c in feat.FEATURES]), f"{p}_name")
    return pairs


@on("pair_similarity", "name_pairs")
def _(pairs):
    return similarity.score_pairs(named_pairs(pairs, False), ratio=similarity.EQUAL).select("a_name", "b_name", "score")


@on("pair_similarity_legacy", "name_pairs")
def _(pairs):
    return similarity.score_pairs(named_pairs(pairs, True), "legacy", similarity.EQUAL).select("a_name", "b_name", "score")


@on("pair_sequence_ratio", "name_pairs")
def _(pairs):
    return named_pairs(pairs, False).select("a_name", "b_name", similarity.text_ratio(F.col("a_canonical_text"), F.col("b_canonical_text")).alias("ratio"))


@on("relation_rows", "same_listings")
def _(listings):
    clusters, members = exact_clusters(listings)
    rows = report.relation_rows(report.named_clusters(clusters, members), members, STORES)
    return rows.select("product_name", "source", *[F.col("stores")[s][c].alias(f"{s}_{c}") for s in STORES for c in ("product_key", "price")])


# relations sheets


@on("provider_map", "lists")
def _(lists):
    return relations.provider_mapping(lists.select(F.concat_ws(" ", F.col("list_ord").cast("string"), text.clean_text(F.col("list_name"))).alias("store"), F.col("list_ord").alias("store_ord")))


@on("standard_to_manual", "standard_sheet")
def _(sheet):
    return relations.relations_to_manual(sheet, STORES)


@on("provider_to_manual", "standard_sheet")
def _(sheet):
    return relations.relations_to_manual(sheet.select("row_ord", *[F.col(c).alias(d) for c, d in relations.DISPLAY.items()]), STORES)


@on("legacy_to_manual", "standard_sheet")
def _(sheet):
    legacy = sheet.select("row_ord", F.col("nombre_producto").alias("Product"), *[F.col(c).alias(f"{s} Product") for s, c in (("North", "nombre_sysco"), ("South", "nombre_kohl"))])
    return relations.relations_to_manual(legacy, ["North", "South"])


@on("to_standard", "standard_sheet")
def _(sheet):
    wide = sheet.select(F.col("nombre_producto").alias("Product"), F.col("nombre_usfood").alias("US FOOD Product"), F.col("nombre_sysco").alias("SYSCO Product"))
    return relations.relations_to_standard(wide, {"US FOOD": "usfood", "SYSCO": "sysco", "KOHL": "kohl"})


@on("manual_to_standard", "manual_rows")
def _(manual):
    mapping = relations.provider_mapping(relations.store_frame(manual.sparkSession, STORES))
    return relations.manual_to_standard(manual, mapping)


@on("display_headers", "standard_sheet")
def _(sheet):
    return relations.displayed(sheet.select(*relations.DISPLAY))


def merged_relations(manual: DataFrame, min_stores: int) -> DataFrame:
    other = manual.withColumn("ref", F.when(F.col("manual_ord") % 2 == 0, F.col("ref")).otherwise(F.concat(F.lit(" "), F.upper("ref"))))
    found = relations.merge_manual([(0, manual.where("store <> 'KOHL' or ref <> 'N/A'")), (1, other)], min_stores)
    return found.select("source_rank", "manual_ord", "product_name", F.array_join(F.transform("stores", lambda x: F.concat(x["store"], F.lit("="), x["ref"])), ";").alias("stores"))


@on("merge_dedupe", "manual_rows")
def _(manual):
    return merged_relations(manual, 2)


@on("duplicate_claims", "manual_rows")
def _(manual):
    return relations.duplicate_claims(manual)


@on("editor_rows", "same_listings", "manual_rows")
def _(listings, manual):
    return relations.editor_rows(manual, catalog.build_catalog(listings))


@on("saved_json", "manual_rows")
def _(manual):
    saved = files.saved_json(manual.withColumn("signature", F.sha1((F.col("manual_ord") % 7).cast("string").cast("binary"))))
    return files.parse_saved(saved)


@on("saved_lines", "manual_rows")
def _(manual):
    path = shared_path(manual.sparkSession, "saved")
    files.write_saved_lines(manual.withColumn("signature", F.sha1((F.col("manual_ord") % 7).cast("string").cast("binary"))), path)
    return files.read_saved_lines(manual.sparkSession, path)


@on("read_checked", "listing_lines")
def _(lines):
    path = shared_path(lines.sparkSession, "lines")
    lines.select("line").write.text(path)
    rows, quarantine = files.read_checked(lines.sparkSession, path, "listings")
    return rows.select("product_key", "price", F.lit(None).cast("string").alias("raw")).unionByName(quarantine.select("raw"), allowMissingColumns=True)


@on("chosen_sheet", "manual_rows")
def _(manual):
    book = F.col("manual_ord") % 4
    name = F.when((F.col("store_pos") == 1) & (book < 2), "Cuadro_Relaciones").when((F.col("store_pos") == 2) & (book == 1), "Relations").otherwise(F.concat(F.lit("Sheet"), F.col("store_pos").cast("string")))
    sheets = manual.select(book.alias("workbook"), name.alias("sheet_name"), F.col("store_pos").alias("sheet_ord"), "manual_ord", "ref")
    return relations.chosen_sheet(sheets)
