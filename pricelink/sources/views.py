"""Price-list tables derived from the star schema, in SQL that Spark and DuckDB both run.

Tables appear as {part}, {lineitem}, ...; {listings} and the other names below are views built of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STORES = ["SYSCO", "US FOOD", "KOHL"]
STORE = "CASE l_suppkey % 3 WHEN 0 THEN 'SYSCO' WHEN 1 THEN 'US FOOD' ELSE 'KOHL' END AS store, CAST(l_suppkey % 3 AS INT) AS store_ord"
PRICE = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE floor(l_extendedprice / l_quantity * 100) / 100 END AS price"

VIEWS = {
    "listings": f"""
SELECT store, store_ord, lower(product_name) AS product_key, product_name, price FROM (
  SELECT {STORE}, {PRICE}, CASE l_suppkey % 3 WHEN 0 THEN p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) || ' CT'
    WHEN 1 THEN p_type || ' ' || p_name || ' ' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN 'CT' ELSE ' CT' END
    ELSE replace(p_name, 'red', 'rojo') || ' ' || p_type || ' ' || CAST(p_size AS STRING) || ' CT' END AS product_name
  FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) AS x""",
    "same_listings": f"""
SELECT {STORE}, lower(p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) || ' CT') AS product_key, p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) || ' CT' AS product_name, {PRICE}
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "records": """
SELECT p_partkey % 20 AS doc_id, p_partkey AS rec_ord, p_name AS product_name, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN 'CS' ELSE 'EA' END AS price_unit,
  '1 ' || CAST(p_size AS STRING) || ' CT' AS pack_size, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(10000 + p_partkey % 700 AS STRING) END AS product_id FROM {part}""",
    "page_text": """
SELECT CAST(p_partkey % 50 AS BIGINT) AS doc_id, CAST(p_partkey % 3 + 1 AS INT) AS page,
  CASE WHEN p_partkey % 11 = 0 THEN 'Order guide of the week' ELSE CAST(p_partkey + 10000 AS STRING) || ' 1 10 LB ' || p_brand || ' ' || p_name || ' __ $' || CAST(p_retailprice AS STRING) || ' CS' END AS text FROM {part}""",
    "table_rows": """
SELECT doc_id, page, table_no, row_no, cells FROM (
  SELECT CAST(p_partkey % 40 AS BIGINT) AS doc_id, 1 AS page, 0 AS table_no, CAST(floor(p_partkey / 40) AS INT) + 2 AS row_no,
    CASE WHEN p_partkey % 13 = 0 THEN ARRAY('', CAST('  ' AS STRING), '', '') WHEN p_partkey % 17 = 0 THEN ARRAY('Item #', 'Product Description', 'Pack', 'Unit Price')
      WHEN p_partkey % 19 = 0 THEN ARRAY(p_name) ELSE ARRAY(CAST(p_partkey + 10000 AS STRING), p_name || ' ' || p_type, '1 ' || CAST(p_size AS STRING), '$' || CAST(p_retailprice AS STRING)) END AS cells FROM {part}
  UNION ALL SELECT DISTINCT CAST(p_partkey % 40 AS BIGINT), 1, 0, 1, CASE WHEN p_partkey % 40 = 7 THEN ARRAY('A', 'B', 'C', 'D') WHEN p_partkey % 40 = 8 THEN ARRAY('Name', '', 'Name', 'Cost') ELSE ARRAY('Item #', 'Product Description', 'Pack', 'Unit Price') END FROM {part}
  UNION ALL SELECT CAST(p_partkey % 40 + 40 AS BIGINT), 1, 0, CAST(floor(p_partkey / 40) AS INT), ARRAY(CAST(p_partkey + 10000 AS STRING) || ' 2 5 KG ' || p_brand || ' ' || p_name || ' ' || CAST(p_retailprice AS STRING) || ' EA') FROM {part}) AS x""",
    "cascade_rows": "SELECT -doc_id - 1 AS doc_id, page, table_no, row_no, cells FROM {table_rows}",
    "cascade_text": "SELECT -doc_id - 61 AS doc_id, page, text FROM {page_text}",
    "listing_lines": """
SELECT p_partkey, chr(123) || CASE p_partkey % 10 WHEN 3 THEN '"store": "SYSCO", "product_key": ' || CAST(p_partkey AS STRING) WHEN 4 THEN '"store": "KOHL", "product_key": "' || CAST(p_partkey AS STRING) || '", "price": "none"' || chr(125)
  ELSE '"store": "KOHL", "store_ord": 2, "product_key": "' || CAST(p_partkey AS STRING) || '", "product_name": "' || p_name || '", "price": ' || CAST(p_size AS STRING) || '.5' || chr(125) END AS line FROM {part}""",
    "order_rows": """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS r, l_partkey, l_suppkey, l_linenumber, p_name, p_type, p_size
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fragments": """
SELECT doc_id, 1 AS page, CAST(792 AS DOUBLE) AS page_height, text, CAST(x AS DOUBLE) AS x, CAST(end_x AS DOUBLE) AS end_x, CAST(y AS DOUBLE) AS y FROM (
  SELECT doc_id, CAST(10000 + l_partkey AS STRING) AS text, 40 AS x, 70 AS end_x, 120 + 18 * r AS y FROM {order_rows}
  UNION ALL SELECT doc_id, split_part(p_name, ' ', 1), 100, 128, 120 + 18 * r + (l_partkey % 3) * 0.5 FROM {order_rows}
  UNION ALL SELECT doc_id, split_part(p_name, ' ', 2), 132, 160, 120 + 18 * r FROM {order_rows}
  UNION ALL SELECT doc_id, p_type, 166, 200, 120 + 18 * r + 7 FROM {order_rows}
  UNION ALL SELECT doc_id, '1 ' || CAST(p_size AS STRING) || ' CT', 300, 340, 120 + 18 * r + 1 FROM {order_rows}
  UNION ALL SELECT doc_id, CASE WHEN l_linenumber = 7 THEN 'No Price' ELSE '$' || CAST(l_partkey % 500 + 1 AS STRING) || '.' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') || CASE WHEN l_linenumber % 2 = 0 THEN ' CS' ELSE ' / EA' END END, 420, 450, 120 + 18 * r FROM {order_rows}
  UNION ALL SELECT DISTINCT doc_id, 'Item', 40, 70, 80 FROM {order_rows}
  UNION ALL SELECT DISTINCT doc_id, 'Product', 100, 130, 80 FROM {order_rows}
  UNION ALL SELECT DISTINCT doc_id, 'Description', 137, 190, 80 FROM {order_rows}
  UNION ALL SELECT DISTINCT doc_id, 'Pack', 300, 330, 80 FROM {order_rows}
  UNION ALL SELECT DISTINCT doc_id, 'Price', 420, 450, 81 FROM {order_rows}) AS f""",
    "lists": """
SELECT CAST(s_suppkey AS INT) AS list_ord, CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Sysco  North' WHEN 2 THEN s_name ELSE 'us food' END AS list_name,
  'lists/' || CASE WHEN s_suppkey % 9 = 0 THEN 'sysco' WHEN s_suppkey % 9 = 4 THEN 'us foods ' ELSE '' END || CAST(s_suppkey % 37 AS STRING) || CASE WHEN s_suppkey % 10 = 3 THEN '.txt' ELSE '.PDF' END AS path, s_suppkey AS doc_id FROM {supplier}""",
    "list_pages": """
SELECT CAST(floor(doc_id / 10) AS BIGINT) AS doc_id, CAST(doc_id % 10 + 1 AS INT) AS page, CASE doc_id % 5 WHEN 0 THEN 'Kohl Wholesale order guide ' WHEN 1 THEN 'US  Foods ' ELSE '' END || text AS text FROM {documents}""",
    "manual_rows": """
SELECT p_partkey AS manual_ord, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Group ' || p_name END AS product_name, store_pos, store,
  CASE WHEN p_partkey % 7 = store_pos THEN 'N/A' WHEN store_pos = 0 THEN p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) || ' CT' ELSE lower(p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) || ' CT') END AS ref
FROM {part} CROSS JOIN (SELECT 0 AS store_pos, 'SYSCO' AS store UNION ALL SELECT 1, 'US FOOD' UNION ALL SELECT 2, 'KOHL') AS s""",
    "name_pairs": """
SELECT DISTINCT a_name, b_name FROM (
  SELECT p.p_name || ' ' || p.p_type || ' ' || CAST(p.p_size AS STRING) || ' CT' AS a_name, CASE k WHEN 0 THEN q.p_type || ' ' || q.p_name || ' ' || CAST(q.p_size AS STRING) || ' CT'
    WHEN 1 THEN replace(q.p_name, 'red', 'rojo') || ' ' || q.p_type || ' ' || CAST(q.p_size AS STRING) || 'CT' WHEN 2 THEN 'Fresh ' || q.p_name WHEN 3 THEN 'frozen ' || p.p_name || ' ' || CAST(q.p_size AS STRING) || ' CT' ELSE p.p_name || ' ' || p.p_type || ' ' || CAST(p.p_size AS STRING) || ' CT' END AS b_name
  FROM {part} p JOIN {part} q ON q.p_partkey BETWEEN p.p_partkey AND p.p_partkey + 2 CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS s) AS x""",
    "name_pairs_names": "SELECT a_name AS product_name FROM {name_pairs} UNION SELECT b_name FROM {name_pairs}",
    "standard_sheet": """
SELECT p_partkey AS row_ord, CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE p_name END AS nombre_producto, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE p_name || ' ' || p_type END AS nombre_sysco,
  CASE WHEN p_partkey % 2 = 0 THEN 'Sin Dato' ELSE ' ' || p_type || '  ' || p_name END AS nombre_kohl, CASE WHEN p_partkey % 6 < 3 THEN NULL ELSE p_brand END AS nombre_usfood FROM {part}""",
}


def dealt_lists(prefix: str, each: int) -> dict[str, str]:
    """Views of price lists, `each` for every way of reading (positioned words, tables, lines), with one that has no pages and
    one that is listed twice. The documents of a way are dealt to its lists."""
    n = 3 * each
    return {
        f"{prefix}_lists": f"""
SELECT CAST(d AS INT) AS list_ord, CASE WHEN d > {n} THEN 'x' WHEN d % 4 = 0 THEN 'Sysco' WHEN d % 4 = 2 THEN 'Store ' || CAST(d % 6 AS STRING) ELSE ' ' END AS list_name,
  'lists/' || CASE d % 8 WHEN 1 THEN 'kohls ' WHEN 3 THEN 'US Foods ' ELSE 'list ' END || CAST(CASE WHEN d > {n} THEN 0 ELSE d END AS STRING) || '.PDF' AS path, CAST(d AS BIGINT) AS doc_id
FROM (SELECT DISTINCT p_partkey % {n + 2} AS d FROM {{part}}) AS x""",
        f"{prefix}_fragments": f"SELECT CAST(doc_id % {each} AS BIGINT) AS doc_id, CAST(floor(doc_id / {each}) AS INT) AS page, page_height, text, x, end_x, y FROM {{fragments}}",
        f"{prefix}_rows": f"SELECT CAST({each} + doc_id % {each} AS BIGINT) AS doc_id, page, CAST(floor(doc_id / {each}) AS INT) AS table_no, row_no, cells FROM {{table_rows}}",
        f"{prefix}_text": f"SELECT CAST({2 * each} + doc_id % {each} AS BIGINT) AS doc_id, CAST(floor(doc_id / {each}) * 3 + page AS INT) AS page, text FROM {{page_text}}",
    }


VIEWS |= dealt_lists("few", 1) | dealt_lists("many", 20)


def word(text: str, x: float, end_x: float, y: float | str) -> str:
    """A word of a page as a struct."""
    return f"named_struct('text', {text}, 'x', CAST({x} AS DOUBLE), 'end_x', CAST({end_x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


#: Views that Spark reads in another form with the same rows.
#: name_pairs: keys are whole numbers, so the next parts are those with one of three keys: a join on equal keys, where a range
#: would meet every part with every part.
#: order_rows: the key goes by its new name before rows are numbered, so that Spark knows they lie by it.
#: fragments: the words of an order row in one pass, where a union would make the rows anew for each word; the header stands once
#: an order, so with its first row. Rows stay where their order is, so nothing is exchanged to group them by page.
IN_SPARK = {
    "name_pairs": VIEWS["name_pairs"].replace("JOIN {part} q ON q.p_partkey BETWEEN p.p_partkey AND p.p_partkey + 2", "CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) AS d JOIN {part} q ON q.p_partkey = p.p_partkey + d.n"),
    "order_rows": """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS r, l_partkey, l_suppkey, l_linenumber, p_name, p_type, p_size
FROM (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, p_name, p_type, p_size FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) AS o""",
    "fragments": f"""
SELECT doc_id, 1 AS page, CAST(792 AS DOUBLE) AS page_height, w.text, w.x, w.end_x, w.y FROM {{order_rows}} LATERAL VIEW inline(concat(array(
  {word("CAST(10000 + l_partkey AS STRING)", 40, 70, "120 + 18 * r")},
  {word("split_part(p_name, ' ', 1)", 100, 128, "120 + 18 * r + (l_partkey % 3) * 0.5")},
  {word("split_part(p_name, ' ', 2)", 132, 160, "120 + 18 * r")},
  {word("p_type", 166, 200, "120 + 18 * r + 7")},
  {word("'1 ' || CAST(p_size AS STRING) || ' CT'", 300, 340, "120 + 18 * r + 1")},
  {word("CASE WHEN l_linenumber = 7 THEN 'No Price' ELSE '$' || CAST(l_partkey % 500 + 1 AS STRING) || '.' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') || CASE WHEN l_linenumber % 2 = 0 THEN ' CS' ELSE ' / EA' END END", 420, 450, "120 + 18 * r")}),
  CASE WHEN r = 1 THEN array({word("'Item'", 40, 70, 80)}, {word("'Product'", 100, 130, 80)}, {word("'Description'", 137, 190, 80)}, {word("'Pack'", 300, 330, 80)}, {word("'Price'", 420, 450, 81)}) ELSE array() END)) w""",
}


def dialect(sql: str) -> str:
    return sql.replace("ARRAY(", "list_value(")


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
NAME = re.compile(r"\{(" + "|".join([*VIEWS, *TABLES]) + r")\}")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(NAME.findall(sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table of the star schema itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(IN_SPARK.get(name, VIEWS[name]), **{n: view(spark, sf_dir, n) for n in names_in(VIEWS[name])})


def duckdb_sql(sql: str) -> str:
    """A query over {views} as one DuckDB statement."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in parts:
            for n in names_in(VIEWS[name]):
                add(n)
            parts[name] = NAME.sub(r"\1", VIEWS[name])

    for n in names_in(sql):
        add(n)
    body = NAME.sub(r"\1", sql).strip()
    if not parts:
        return dialect(body)
    head = ", ".join(f"{n} AS ({q})" for n, q in parts.items())
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return dialect(f"{start}{head}, {body.removeprefix(start)}")
    return dialect(f"WITH {head} {body}")
