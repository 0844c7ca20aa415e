"""Price records from the words of a page by their place: lines, cells, header, columns, rows.

All steps work within (doc_id, page). Fragments: doc_id, page, page_height, text, x, end_x, y.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import once
from ..functions.text import clean_text, has_text, is_price_header, is_product_header, normalize_key, price_candidate, product_id, tidy
from ..sources.tables import staged
from .catalog import group_records
from .tables import single_column_records, tabular_records

PAGE = ["doc_id", "page"]
LINE_GAP, CELL_GAP, GLUE_GAP, HEADER_GAP = 2.5, 6.0, 1.5, 8.0
#: Headers lie in this upper part of a page; the cells of a header row lie this near to its height.
HEADER_PART, HEADER_NEAR = 0.48, 8


def run_starts(items: str, opens: Callable[[Column, Column], Column], mark: str) -> Column:
    """The indexes at which `opens` starts a new run, in one pass over an array. It sees what has been noted (n: items so far;
    first, last: `mark` of the run's first item and of the item before) and the item."""

    def step(acc: Column, w: Column) -> Column:
        new = opens(acc, w)
        return F.struct((acc["n"] + 1).alias("n"), F.when(new, w[mark]).otherwise(acc["first"]).alias("first"), w[mark].alias("last"),
            F.when(new, F.concat(acc["starts"], F.array(acc["n"]))).otherwise(acc["starts"]).alias("starts"))

    none = F.lit(None).cast("double")
    return F.aggregate(items, F.struct(F.lit(0).alias("n"), none.alias("first"), none.alias("last"), F.array().cast("array<int>").alias("starts")), step)["starts"]


def apart(items: str, start: str, end: str, gap: float) -> Column:
    """The indexes of the first item and of those whose start lies more than gap behind the end of the item before."""
    return F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (F.get(items, i)[start] - F.get(items, i - 1)[end] > gap))


def runs_of(items: str, starts: str) -> Column:
    """The runs of an array, cut at the indexes of another; items are copied once."""
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(items))
    return F.transform(starts, lambda at, i: F.slice(items, at + 1, end(i) - at))


def cut_lines(fragments: DataFrame) -> DataFrame:
    """One row a line: page_height, line_no (from 0), line_y and `_line`, its fragments from left to right. A fragment joins
    the line whose first fragment lies within LINE_GAP above it: runs of near neighbours are lines, and only where one reaches
    further are lines told apart one by one."""
    rows = fragments.where(has_text(F.col("text"))).withColumn("text", tidy(F.col("text")))
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "end_x", "text")))
    pages = rows.groupBy(*PAGE).agg(F.first("page_height").alias("page_height"), ordered.alias("_all"))
    noted = pages.withColumn("_near", apart("_all", "y", "y", LINE_GAP))
    one_by_one = run_starts("_all", lambda acc, w: acc["first"].isNull() | (w["y"] - acc["first"] > LINE_GAP), "y")
    long = F.exists(runs_of("_all", "_near"), lambda p: F.coalesce(F.element_at(p, -1)["y"] - F.get(p, F.lit(0))["y"] > LINE_GAP, F.lit(True)))
    noted = noted.withColumn("_starts", F.when(long, one_by_one).otherwise(F.col("_near"))).drop("_near")
    lines = F.transform(runs_of("_all", "_starts"), lambda p, i: F.struct(i.alias("line_no"), F.get(p, F.lit(0))["y"].alias("line_y"), p.alias("_line")))
    each = noted.select(*PAGE, "page_height", F.inline(lines))
    return each.withColumn("_line", F.sort_array(F.transform("_line", lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"), w["end_x"].alias("end_x"), w["text"].alias("text")))))


def page_lines(fragments: DataFrame) -> DataFrame:
    """Fragments with line_no and line_y."""
    each = cut_lines(fragments).select(*PAGE, "page_height", "line_no", "line_y", F.explode("_line").alias("w"))
    return each.select(*PAGE, "page_height", "line_no", "line_y", "w.text", "w.x", "w.end_x", "w.y")


def with_merged(lines: DataFrame, items: str, gap: float, out: str) -> DataFrame:
    """Adds `out`: neighbours in `items` (ordered structs of x, y, end_x and a clean text) at most `gap` apart as one cell."""
    noted = lines.withColumn("_cuts", apart(items, "x", "end_x", gap))
    cell = lambda p: F.struct(F.get(p, F.lit(0))["x"].alias("x"), F.get(p, F.lit(0))["y"].alias("y"), F.element_at(p, -1)["end_x"].alias("end_x"),
        F.array_join(F.transform(p, lambda w: w["text"]), " ").alias("text"))
    return noted.withColumn(out, F.transform(runs_of(items, "_cuts"), cell)).drop("_cuts")


def cells_of(lines: DataFrame, items: str) -> DataFrame:
    """One row a cell of an array of cells, numbered from 0."""
    numbered = F.transform(items, lambda c, i: F.struct(i.alias("cell_no"), c["text"].alias("text"), c["x"].alias("x"), c["end_x"].alias("end_x"), c["y"].alias("y")))
    return lines.select(*PAGE, "page_height", "line_no", "line_y", F.inline(numbered))


def merged(items: DataFrame, gap: float) -> DataFrame:
    """Neighbours of a line (text, x, end_x, y, line_no, line_y) at most `gap` apart as one cell; of those at one x, the
    upper one comes first."""
    parts = F.sort_array(F.collect_list(F.struct("x", "y", "end_x", "text")))
    return cells_of(with_merged(items.groupBy(*PAGE, "page_height", "line_no", "line_y").agg(parts.alias("_p")), "_p", gap, "_cells"), "_cells")


def line_cells(lines: DataFrame) -> DataFrame:
    return merged(lines, CELL_GAP)


def page_cells(fragments: DataFrame) -> DataFrame:
    """The cells of all lines, line by line."""
    return cells_of(with_merged(cut_lines(fragments), "_line", CELL_GAP, "_cells"), "_cells")


def page_texts(fragments: DataFrame, gap: float = GLUE_GAP) -> DataFrame:
    """The text of each line, as line_texts, line by line."""
    lines = with_merged(cut_lines(fragments), "_line", CELL_GAP, "_cells").withColumn("_cells", F.sort_array("_cells"))
    parts = F.transform("_cells", lambda c, i: F.concat(F.when(c["x"] - F.get("_cells", i - 1)["end_x"] > gap, " ").otherwise(""), c["text"]))
    return lines.withColumn("_t", F.array_join(parts, "")).select(*PAGE, "line_no", "line_y", tidy(F.col("_t")).alias("text"))


def line_texts(cells: DataFrame, gap: float = GLUE_GAP) -> DataFrame:
    """The text of each line: a space where cells are more than `gap` apart."""
    line = Window.partitionBy(*PAGE, "line_no").orderBy("x", "y", "end_x", "text")
    apart = F.when(F.col("x") - F.lag("end_x").over(line) > gap, " ").otherwise("")
    parts = cells.withColumn("_s", F.concat(apart, F.col("text"))).groupBy(*PAGE, "line_no", "line_y").agg(F.sort_array(F.collect_list(F.struct("x", "y", "end_x", "text", "_s"))).alias("_p"))
    return parts.select(*PAGE, "line_no", "line_y", clean_text(F.array_join(F.transform("_p", lambda p: p["_s"]), "")).alias("text"))


def header_cells(cells: DataFrame) -> DataFrame:
    return merged(cells, HEADER_GAP)


def header_pairs(heads: DataFrame) -> DataFrame:
    """The pair of a product header and a price header of each page: in the upper part, product left of price, close in
    height; the closest, then the first."""
    upper = heads.where(F.col("line_y") <= HEADER_PART * F.col("page_height"))
    p = upper.where(is_product_header(F.col("text"))).select(*PAGE, F.col("line_no").alias("p_line"), F.col("cell_no").alias("p_cell"), F.col("line_y").alias("p_y"), F.col("x").alias("p_x"), F.col("end_x").alias("p_end"))
    r = upper.where(is_price_header(F.col("text"))).select(*PAGE, F.col("line_no").alias("r_line"), F.col("cell_no").alias("r_cell"), F.col("line_y").alias("r_y"), F.col("x").alias("r_x"), F.col("end_x").alias("r_end"))
    pairs = p.join(r, PAGE).where((F.col("p_x") < F.col("r_x")) & (F.abs(F.col("p_y") - F.col("r_y")) <= 32))
    score = F.abs(F.col("p_y") - F.col("r_y")) + 3 * F.abs(F.col("p_line") - F.col("r_line"))
    best = Window.partitionBy(*PAGE).orderBy("score", "p_line", "p_cell", "r_line", "r_cell")
    return pairs.withColumn("score", score).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def column_bounds(heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a page: header_bottom and the start and end of the product, price, pack and id columns."""
    row = heads.join(pairs, PAGE).where(F.abs(F.col("line_y") - (F.col("p_y") + F.col("r_y")) / 2) <= HEADER_NEAR)
    key, place = normalize_key(F.col("text")), F.struct("line_no", "cell_no")
    cell = F.struct("x", "end_x")
    kind = lambda when, by: F.min_by(F.when(when, cell), F.when(when, by))
    items = F.collect_list(cell)
    found = row.groupBy(*PAGE, "p_x", "p_end", "r_x", "r_end").agg(
        (F.max("line_y") + 4).alias("header_bottom"),
        F.max(F.when(F.col("end_x") < F.col("p_x"), F.col("end_x"))).alias("before"),
        F.min(F.when(F.col("x") > F.col("p_end") + 8, F.col("x"))).alias("after"),
        F.min(F.when(F.col("x") > F.col("r_end") + 8, F.col("x"))).alias("after_price"),
        kind(key.contains("pack"), F.struct(F.col("x"), F.col("line_no"), F.col("cell_no"))).alias("pack"),
        F.coalesce(kind(key.contains("upc"), place), kind(key == "item", place), kind(F.col("text").contains("#") & key.contains("product"), place)).alias("ident"),
        items.alias("_items"))

    def bounds(name: str) -> list[Column]:
        head = F.col(name)
        left = F.array_max(F.transform(F.filter("_items", lambda i: i["end_x"] < head["x"]), lambda i: i["end_x"]))
        right = F.array_min(F.transform(F.filter("_items", lambda i: i["x"] > head["end_x"]), lambda i: i["x"]))
        start = F.coalesce((left + head["x"]) / 2, F.greatest(F.lit(0.0), head["x"] - 40))
        end = F.coalesce((head["end_x"] + right) / 2, F.lit(float("inf")))
        return [F.when(head.isNotNull(), start).alias(f"{name}_start"), F.when(head.isNotNull(), end).alias(f"{name}_end")]

    return found.select(*PAGE, "header_bottom",
        F.coalesce(F.col("before") + 4, F.greatest(F.lit(0.0), F.col("p_x") - 40)).alias("product_start"), F.coalesce((F.col("p_end") + F.col("after")) / 2, F.col("r_x") - 24).alias("product_end"),
        (F.col("r_x") - 32).alias("price_start"), F.coalesce(F.col("after_price") - 6, F.lit(float("inf"))).alias("price_end"), *bounds("pack"), *bounds("ident"))


def within(x: Column, name: str) -> Column:
    return (x >= F.col(f"{name}_start")) & (x < F.col(f"{name}_end"))


def price_rows(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Lines below the header with a price (or `no price`) in the price column: line_no, y, price, unit."""
    below = cells.join(bounds.hint("shuffle_hash"), PAGE).where((F.col("line_y") > F.col("header_bottom")) & within(F.col("x"), "price"))
    texts = below.groupBy(*PAGE, "line_no", "line_y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", "cell_no", "text"))), lambda p: p["text"]), " ").alias("text"))
    rows = texts.withColumn("_p", price_candidate(F.col("text")))
    none = normalize_key(F.col("text")).contains("no price")
    has = F.col("_p.price") > 0
    return rows.where(has | none).select(*PAGE, "line_no", F.col("line_y").alias("y"), F.when(has, F.col("_p.price")).alias("price"), F.when(has, F.col("_p.unit")).otherwise("").alias("unit"))


def row_windows(rows: DataFrame) -> DataFrame:
    """How far from a price row its texts may lie, by the usual distance of price rows of the page: PAGE, row_window."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy(*PAGE).orderBy("y", "line_no"))
    gaps = rows.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap") > 4, F.col("gap")))
    middle = gaps.withColumn("mid", F.median("gap").over(Window.partitionBy(*PAGE)))
    usual = middle.groupBy(*PAGE).agg(F.median(F.when(F.col("gap") >= F.col("mid"), F.col("gap"))).alias("usual"))
    return usual.select(*PAGE, F.least(F.lit(24.0), F.greatest(F.lit(6.0), F.coalesce(F.col("usual") * 0.45, F.lit(12.0)))).alias("row_window"))


def row_records(cells: DataFrame, bounds: DataFrame, rows: DataFrame, windows: DataFrame) -> DataFrame:
    """A record for each price row: the texts near it in the product, pack and id columns. Bounds are one row a page, so they are
    hashed and cells need no sort. rec_ord, by which the records of a
    document are ordered, is the place of the row, so no task has to number a whole document."""
    kinds = ["product", "pack", "ident"]
    below = cells.join(bounds.hint("shuffle_hash"), PAGE).where(F.col("line_y") > F.col("header_bottom"))
    below = below.select(*PAGE, "line_y", "x", "y", "cell_no", "text", *[within(F.col("x"), name).alias(name) for name in kinds]).where("product or pack or ident")
    near = rows.join(windows.hint("shuffle_hash"), PAGE).select(*PAGE, F.col("line_no").alias("row_no"), F.col("y").alias("row_y"), "price", "unit", "row_window")
    each = below.join(near.hint("shuffle_hash"), PAGE).where(F.abs(F.col("line_y") - F.col("row_y")) <= F.col("row_window"))

    def column(name: str) -> Column:
        got = F.sort_array(F.collect_list(F.when(F.col(name), F.struct("line_y", "x", "y", "cell_no", "text"))))
        return F.array_join(F.transform(got, lambda p: p["text"]), " ")

    found = each.groupBy(*PAGE, "row_no", "row_y", "price", "unit").agg(column("product").alias("product_name"), column("pack").alias("pack_size"), product_id(column("ident")).alias("product_id"))
    return found.where("product_name <> ''").select("doc_id", F.struct("page", "row_y", "row_no").alias("rec_ord"), "product_name", "price", F.col("unit").alias("price_unit"), "pack_size", "product_id")


def prefer_case_prices(records: DataFrame) -> DataFrame:
    """Of the records of a product (by id, else by name and pack) the first one by the case, else the first one."""
    ident = clean_text(F.col("product_id"))
    key = F.when(ident != "", ident).otherwise(F.concat(normalize_key(F.col("product_name")), F.lit("|"), normalize_key(F.col("pack_size"))))
    best = Window.partitionBy("doc_id", "_key").orderBy(F.desc("_case"), "rec_ord")
    rows = records.withColumn("_key", key).withColumn("_case", F.coalesce(F.col("price_unit") == "CS", F.lit(False)))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_key", "_case")


def disambiguate(records: DataFrame) -> DataFrame:
    """Names that several records of a document share get their pack or id in brackets."""
    ident = clean_text(F.col("product_id"))
    pack = F.regexp_replace(clean_text(F.col("pack_size")), r"^1\s+(?=\S)", "")
    rows = records.withColumn("_norm", normalize_key(F.col("product_name"))).withColumn("_q", F.when(pack != "", pack).otherwise(F.concat(F.lit("Item "), ident)))
    rows = rows.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_norm"))).withColumn("_again", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_norm", "_q")))
    mark = F.when((F.col("_again") > 1) & (ident != ""), F.concat("_q", F.lit(" · "), ident)).otherwise(F.col("_q"))
    name = F.when(F.col("_same") > 1, F.concat(clean_text(F.col("product_name")), F.lit(" ["), mark, F.lit("]"))).otherwise(F.col("product_name"))
    return rows.withColumn("product_name", name).drop("_norm", "_q", "_same", "_again")


def named_lines(fragments: DataFrame) -> DataFrame:
    """One row a line with `cells`, and `named`, whether it has words of a header where headers may lie."""
    lines = with_merged(cut_lines(fragments), "_line", CELL_GAP, "cells").drop("_line").withColumn("_t", F.array_join("cells.text", " "))
    words = F.when(F.col("_t").rlike(r"[^\x00-\x7f]"), normalize_key(F.col("_t")).rlike("description|product name|price|cost")).otherwise(F.col("_t").rlike("(?i)description|product[^a-z0-9]+name|price|cost"))
    return once(lines, {"named": (F.col("line_y") <= HEADER_PART * F.col("page_height")) & words}).drop("_t")


def line_table(fragments: DataFrame) -> DataFrame:
    """One row a line with `cells`, and `named`, whether it has words of a header where headers may lie; written in buckets of
    pages. What follows is done page by page, so this is the only exchange by page."""
    return staged(named_lines(fragments), "lines", PAGE)


def heads_of(lines: DataFrame) -> DataFrame:
    """The header cells of lines with an array of cells."""
    return cells_of(with_merged(lines.withColumn("cells", F.sort_array("cells")), "cells", HEADER_GAP, "heads"), "heads")


def found_pairs(fragments: DataFrame) -> DataFrame:
    """The header pair of each page, of the lines with words of a header only."""
    return header_pairs(staged(heads_of(named_lines(fragments).where("named")), "heads"))


def found_bounds(lines: DataFrame) -> DataFrame:
    """The columns of each page. Header cells are made of the lines with words of a header, then of the lines near the pair found."""
    pairs = staged(header_pairs(heads_of(lines.where("named"))), "pairs", PAGE)
    place = pairs.select(*PAGE, ((F.col("p_y") + F.col("r_y")) / 2).alias("_y")).hint("shuffle_hash")
    beside = lines.join(place, PAGE).where(F.abs(F.col("line_y") - F.col("_y")) <= HEADER_NEAR).drop("_y")
    return column_bounds(heads_of(beside), pairs)


def found_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds, price rows) of all pages, written in buckets of pages."""
    bounds = staged(found_bounds(lines), "bounds", PAGE)
    return bounds, staged(price_rows(cells_of(lines, "cells"), bounds), "price_rows", PAGE)


def positioned_raw(fragments: DataFrame) -> DataFrame:
    """The records of all pages that have a header. Lines, bounds and price rows are read several times, so they are written,
    in buckets of pages."""
    lines = line_table(fragments)
    bounds, rows = found_rows(lines)
    return row_records(cells_of(lines, "cells"), bounds, rows, row_windows(rows))


def positioned_records(fragments: DataFrame) -> DataFrame:
    """doc_id, product_key, product_name, price from positioned words."""
    return group_records(disambiguate(prefer_case_prices(positioned_raw(fragments))))


def still_open(rows: DataFrame, *found: DataFrame) -> DataFrame:
    """Rows of the documents in which none of the earlier ways has found anything."""
    for records in found:
        rows = rows.join(records.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows


def parse_listings(fragments: DataFrame, table_rows: DataFrame, page_text: DataFrame) -> DataFrame:
    """Products of each document by the first way that finds any: words by place, tables, text lines; each way reads only
    the documents that the ways before it leave open. Adds source_format."""
    columns = ["doc_id", "product_name", "price"]
    a = staged(positioned_records(fragments).select(*columns), "by_place")
    b = staged(tabular_records(still_open(table_rows, a)).select(*columns), "by_table")
    c = single_column_records(still_open(table_rows, a, b), still_open(page_text, a, b)).select(*columns)
    kept = a.unionByName(b).withColumn("way", F.lit("tabular")).unionByName(c.withColumn("way", F.lit("single-column")))
    ways = kept.groupBy("doc_id").agg(F.first("way").alias("source_format"))
    return group_records(kept.select(*columns)).join(ways, "doc_id").select("doc_id", "product_key", "product_name", "price", "source_format")
