from pricelink.operators import layout, tables
from pricelink.sources.files import SCHEMAS


def test_page_to_products(spark):
    word = lambda t, x, e, y: (1, 1, 792.0, t, float(x), float(e), float(y))
    page = [word("Item", 40, 60, 80), word("Product", 100, 130, 80), word("Description", 137, 190, 81), word("Pack", 300, 320, 80), word("Price", 420, 445, 80)]
    page += [word("12345", 40, 60, 120), word("Beef", 100, 120, 120), word("chuck", 124, 150, 121), word("1 10 LB", 300, 330, 120), word("$12.50 CS", 420, 450, 120)]
    page += [word("12346", 40, 60, 140), word("Beef", 100, 120, 140), word("chuck", 124, 150, 140), word("2 5 LB", 300, 330, 141), word("No Price", 420, 450, 140)]
    page += [word("12345", 40, 60, 160), word("Beef", 100, 120, 160), word("chuck", 124, 150, 160), word("1 10 LB", 300, 330, 160), word("3.10 / LB", 420, 450, 160)]
    got = {(r["product_name"], r["price"]) for r in layout.positioned_records(spark.createDataFrame(page, SCHEMAS["fragments"])).collect()}
    assert got == {("Beef chuck [10 LB]", 12.5), ("Beef chuck [2 5 LB]", None)}


def test_cascade_takes_the_first_way_that_finds_products(spark):
    fragments = spark.createDataFrame([], SCHEMAS["fragments"])
    head = ["Item", "Product Name", "Price"]
    rows = [(1, 1, 0, 0, head), (1, 1, 0, 1, ["1", "Rice", "$2.50"]), (1, 1, 0, 2, ["2", "Salt", "x"]), (1, 1, 0, 3, head), (2, 1, 0, 0, ["12345 1 1 LB Brand Oil 9 CS"])]
    text = [(1, 1, "12345 1 1 LB Brand Oil 9 CS"), (3, 1, "nothing\n54321 1 1 LB Brand Ham 7.5 EA"), (3, 2, "54322 1 1 LB Brand Egg 8 EA"), (4, 1, None)]
    got = layout.parse_listings(fragments, spark.createDataFrame(rows, SCHEMAS["table_rows"]), spark.createDataFrame(text, SCHEMAS["page_text"])).collect()
    assert {(r["doc_id"], r["product_name"], r["price"], r["source_format"]) for r in got} == {(1, "Rice", 2.5, "tabular"), (2, "Brand Oil", 9.0, "single-column"), (3, "Brand Ham", 7.5, "single-column")}


def test_tables_without_header_or_columns_give_nothing(spark):
    rows = [(1, 1, 0, 0, ["a", "b"]), (1, 1, 0, 1, ["c", "1"]), (2, 1, 0, 0, ["Name", "Qty"]), (2, 1, 0, 1, ["x", "1"]), (3, 1, 0, 0, ["", ""])]
    assert tables.tabular_records(spark.createDataFrame(rows, SCHEMAS["table_rows"])).count() == 0


def test_stacked_words_come_from_top_to_bottom(spark):
    words = [(1, 1, 792.0, t, x, e, y) for t, x, e, y in (("Alpha", 100.0, 120.0, 121.0), ("Zulu", 100.0, 128.0, 120.0), ("next", 131.0, 150.0, 120.5), ("far", 300.0, 310.0, 122.0))]
    cells = layout.line_cells(layout.page_lines(spark.createDataFrame(words, SCHEMAS["fragments"])))
    assert [(r["text"], r["x"], r["y"]) for r in cells.orderBy("x").collect()] == [("Zulu Alpha", 100.0, 120.0), ("next", 131.0, 120.5), ("far", 300.0, 122.0)]
    assert [r["text"] for r in layout.line_texts(cells).collect()] == ["Zulu Alpha next far"]


def test_pages_are_exchanged_once(spark):
    words = [(d, p, 792.0, t, x, x + 30.0, y) for d in range(3) for p in range(4) for t, x, y in (("Product Name", 100.0, 80.0), ("Price", 420.0, 80.0), (f"Rice {d}", 100.0, 120.0 + p), ("$2.50", 420.0, 120.0 + p))]
    lines = layout.line_table(spark.createDataFrame(words, SCHEMAS["fragments"]))
    pairs = layout.header_pairs(layout.heads_of(lines.where("named")))
    bounds = layout.column_bounds(layout.heads_of(lines), pairs)
    cells = layout.cells_of(lines, "cells")
    rows = layout.price_rows(cells, bounds)
    found = layout.row_records(cells, bounds, rows, layout.row_windows(rows))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["product_name"], r["price"]) for r in found.collect()) == sorted((d, f"Rice {d}", 2.5) for d in range(3) for _ in range(4))


def test_header_words_over_cells_and_beside_the_pair(spark):
    """A header whose words lie in cells of their own, one with an accent, and a column head on a line near theirs."""
    words = [(1, 1, 792.0, t, float(x), float(e), float(y)) for t, x, e, y in (("Product", 100, 130, 80), ("Description", 137, 190, 80), ("Prîce", 420, 445, 80), ("Pack", 300, 320, 84), ("Oil", 100, 120, 120), ("2 CT", 300, 320, 120), ("$4", 420, 440, 120))]
    got = layout.positioned_raw(spark.createDataFrame(words, SCHEMAS["fragments"])).collect()
    assert [(r["product_name"], r["price"], r["pack_size"]) for r in got] == [("Oil", 4.0, "2 CT")]
