"""DuckDB SQL for the queries, over the views of sources/views.py. Written apart from the Spark code, as a check on it."""

from __future__ import annotations

from ..functions.words import CATEGORIES, GENERIC, KEPT_IN_LEGACY, NOT_IN_LEGACY, STATES, TRANSLATIONS

UNITS = "CS|EA|LB|CT|PK|BX|BG|RL|DZ"
NUM = r"-?\d{1,5}(?:\.\d+)?"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def key(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7f]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def relation(x: str) -> str:
    return f"CASE WHEN lower({clean(x)}) IN ('-', '--', '—', 'n/a', 'na', 'none', 'null', 'sin dato', 's/d') OR {key(x)} = '' THEN '' ELSE {clean(x)} END"


def cast(x: str) -> str:
    return f"TRY_CAST(nullif({x}, '') AS DOUBLE)"


def price(x: str) -> str:
    p = f"replace({clean(x)}, ',', '')"
    return f"coalesce({cast(f"regexp_extract({p}, '(?i)\\$?\\s*({NUM})\\s*/?\\s*({UNITS})\\b', 1)")}, {cast(f"regexp_extract({p}, '\\$\\s*({NUM})', 1)")}, {cast(f"regexp_extract({p}, '^\\s*({NUM})\\s*$', 1)")})"


def unit(x: str) -> str:
    p = f"replace({clean(x)}, ',', '')"
    return f"upper(regexp_extract({p}, '(?i)\\$?\\s*({NUM})\\s*/?\\s*({UNITS})\\b', 2))"


def provider(x: str) -> str:
    return f"CASE WHEN contains({key(x)}, 'kohl') THEN 'KOHL' WHEN contains({key(x)}, 'us food') OR contains({key(x)}, 'usfoods') THEN 'US FOOD' WHEN contains({key(x)}, 'sysco') THEN 'SYSCO' END"


def provider_key(x: str) -> str:
    return f"CASE WHEN contains({key(x)}, 'sysco') THEN 'sysco' WHEN contains({key(x)}, 'kohl') THEN 'kohl' WHEN regexp_matches({key(x)}, '\\busfoods\\b') OR (regexp_matches({key(x)}, '\\bus\\b') AND regexp_matches({key(x)}, '\\bfoods?\\b')) THEN 'usfood' END"


SHAPE = rf"'(?i)^(.*?)\$?(\d{{1,5}}(?:,\d{{3}})*(?:\.\d+)?)\s*(?:{UNITS})\s*$'"


def list_lines(source: str, columns: str) -> str:
    """columns, product_name and price of lines `line` of source that have the shape."""
    return rf"""SELECT {columns}, array_to_string(CASE WHEN len(t) >= 5 THEN t[5:] ELSE t[4:] END, ' ') AS product_name, price FROM (
  SELECT *, string_split_regex(trim(regexp_replace(trim(regexp_extract(c, {SHAPE}, 1)), '[_-]+\s*$', '')), ' +') AS t, {cast(f"replace(regexp_extract(c, {SHAPE}, 2), ',', '')")} AS price
  FROM (SELECT *, {clean('line')} AS c FROM {source}) WHERE regexp_matches(c, '^\d{{4,}}\b') AND NOT contains({key('c')}, 'item pack pack size')) WHERE price IS NOT NULL AND len(t) >= 4"""


def values(pairs) -> str:
    return ", ".join("(" + ", ".join("'" + v + "'" for v in p) + ")" for p in pairs)


def features(legacy: bool, source: str = "{listings}") -> str:
    words = [(k, v) for k, v in TRANSLATIONS.items() if not (legacy and k in NOT_IN_LEGACY)]
    generic = ", ".join(f"'{w}'" for w in GENERIC if not (legacy and w in KEPT_IN_LEGACY))
    one = "CASE WHEN length(t) > 4 AND suffix(t, 's') THEN t[:-2] ELSE t END"
    singular = one if legacy else f"CASE WHEN length(t) > 5 AND suffix(t, 'es') THEN t[:-3] WHEN length(t) > 4 AND suffix(t, 's') THEN t[:-2] ELSE t END"
    return f"""names AS (SELECT DISTINCT product_name FROM {source}),
raw AS (SELECT product_name, unnest(string_split({key('product_name')}, ' ')) AS r, generate_subscripts(string_split({key('product_name')}, ' '), 1) AS i FROM names),
tr(r, en) AS (VALUES {values(words)}), kind(t, category) AS (VALUES {values((t, c) for c, ts in CATEGORIES.items() for t in ts)}), st(t, state) AS (VALUES {values(STATES.items())}),
tok AS (SELECT product_name, i, {singular} AS t FROM (SELECT product_name, i, coalesce(en, raw.r) AS t FROM raw LEFT JOIN tr USING (r))),
kept AS (SELECT * FROM tok WHERE t NOT IN ({generic})),
f AS (SELECT product_name, string_agg(t, ' ' ORDER BY i) AS canonical_text, list_sort(list_distinct(list(t))) AS tokens,
  list_sort(list_distinct(list(t) FILTER (length(t) >= 4 AND NOT regexp_matches(t, '[0-9]')))) AS strong, list_sort(list_distinct(list(t) FILTER (regexp_matches(t, '[0-9]')))) AS numbers,
  list_sort(list_distinct(list(category) FILTER (category IS NOT NULL))) AS categories FROM kept LEFT JOIN kind USING (t) GROUP BY product_name),
s AS (SELECT product_name, list_sort(list_distinct(list(state))) AS states FROM tok JOIN st USING (t) GROUP BY product_name)"""


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '') AS {x}"


OVERLAP = f"""WITH {features(False)},
n AS (SELECT DISTINCT store, product_name FROM {{listings}}), u AS (SELECT store, product_name, f.*, unnest(f.numbers) AS num FROM n JOIN f USING (product_name))"""

CATALOG = f"""cat AS (SELECT store, store_ord, product_key, product_name, price FROM (SELECT store, store_ord, lower({clean('product_key')}) AS product_key, {clean('product_name')} AS product_name, price FROM %s)
  WHERE product_key <> '' AND product_name <> '' AND (price IS NULL OR price > 0)
  QUALIFY row_number() OVER (PARTITION BY store, product_key ORDER BY price NULLS LAST, product_name) = 1)"""
CAT, SAME = CATALOG % "{listings}", CATALOG % "{same_listings}"

EXACT = SAME + """, disp AS (SELECT product_key AS cluster_id, min(store_ord) AS ord, arg_min(product_name, (length(product_name), lower(product_name), product_name)) AS name FROM cat GROUP BY product_key)"""


def pivot(what: str, stores=("SYSCO", "US FOOD", "KOHL")) -> str:
    return ", ".join(f"max({what}) FILTER (store = '{s}') AS \"{s}\"" for s in stores)


def score(legacy: bool, a: str = "a", b: str = "b") -> str:
    """The similarity of two rows with features where the text ratio is one for equal texts, else zero."""
    both = lambda c: f"len(list_intersect({a}.{c}, {b}.{c}))"
    n = lambda x, c: f"len({x}.{c})"
    least = lambda c: f"least({n(a, c)}, {n(b, c)})"
    jaccard = f"({both('tokens')} / greatest(1, len({a}.tokens) + len({b}.tokens) - {both('tokens')}))"
    containment = f"({both('tokens')} / greatest(1, {least('tokens')}))"
    equal = f"CASE WHEN {a}.canonical_text = {b}.canonical_text THEN 1 ELSE 0 END"
    differ = f"({n(a, 'numbers')} > 0 AND {n(b, 'numbers')} > 0 AND {both('numbers')} = 0)"
    if legacy:
        stop = f"{least('tokens')} = 0 OR {differ} OR ({both('strong')} = 0 AND {both('numbers')} = 0)"
        total = f"0.50::DOUBLE * greatest({jaccard}, {containment}) + 0.25::DOUBLE * {jaccard} + CASE WHEN {both('numbers')} > 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN {both('strong')} >= 2 THEN 0.05::DOUBLE ELSE 0 END + 0.25::DOUBLE * {equal}"
    else:
        clash = " OR ".join(f"(list_contains({x}.states, 'fresh') AND list_has_any({y}.states, ['canned', 'frozen']))" for x, y in ((a, b), (b, a)))
        stop = f"{least('tokens')} = 0 OR {clash} OR {differ} OR ({both('strong')} = 0 AND {both('tokens')} < 2 AND {equal} = 0)"
        kinds = f"CASE WHEN {least('categories')} = 0 THEN 0 WHEN {both('categories')} > 0 THEN 0.05::DOUBLE ELSE -0.22::DOUBLE END"
        total = f"0.44::DOUBLE * greatest({jaccard}, {containment}) + 0.26::DOUBLE * ({both('strong')} / greatest(1, {least('strong')})) + CASE WHEN {both('numbers')} > 0 THEN 0.07::DOUBLE ELSE 0 END + {kinds} + 0.30::DOUBLE * {equal}"
    return f"CASE WHEN {stop} THEN 0 ELSE greatest(0, least(1, {total})) END::DOUBLE"


def featured(rows: str, legacy: bool = False) -> str:
    """Rows with product_name, with their features (empty lists for none)."""
    lists = ", ".join(f"coalesce({c}, []) AS {c}" for c in ("tokens", "strong", "numbers", "categories", "states"))
    return f"(SELECT r.*, coalesce(canonical_text, '') AS canonical_text, {lists} FROM {rows} r LEFT JOIN f ON r.product_name = f.product_name LEFT JOIN s ON r.product_name = s.product_name)"


MATCHED = f"""{CAT}, {features(False)}, fx AS {featured('cat')},
m0 AS (SELECT 's0:' || product_key AS cluster_id, 0 AS ord, product_key AS sub, 1.0::DOUBLE AS score, * FROM fx WHERE store = 'SYSCO')"""


def round_of(n: int, store: str) -> str:
    """Tables of the n-th store's round: best candidates b, assigned ones w, and all members m."""
    return f""", i{n} AS (SELECT * FROM fx WHERE store = '{store}'),
e{n} AS (SELECT i.product_key, arg_min(m.cluster_id, (m.ord, m.sub)) AS cluster_id, 1.0::DOUBLE AS score, 0.0::DOUBLE AS second FROM i{n} i JOIN m{n - 1} m USING (product_key) GROUP BY i.product_key),
p{n} AS (SELECT a.product_key, b.cluster_id, b.ord, b.sub, max({score(False)}) AS score FROM (SELECT * FROM i{n} ANTI JOIN e{n} USING (product_key)) a JOIN m{n - 1} b ON list_has_any(a.tokens, b.tokens)
  GROUP BY ALL HAVING score > 0 AND score >= 0.50::DOUBLE - 0.06::DOUBLE - 1e-9::DOUBLE),
b{n} AS (SELECT product_key, cluster_id, score, second FROM (SELECT *, coalesce(lead(score) OVER v, 0.0::DOUBLE) AS second, row_number() OVER v AS n FROM p{n} WINDOW v AS (PARTITION BY product_key ORDER BY score DESC, ord, sub)) WHERE n = 1 UNION ALL SELECT * FROM e{n}),
w{n} AS (SELECT * FROM b{n} WHERE score >= 0.50::DOUBLE AND score - second >= 0.06::DOUBLE QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, product_key) = 1),
c{n} AS (SELECT DISTINCT cluster_id, ord, sub FROM m{n - 1}),
m{n} AS (SELECT * FROM m{n - 1} UNION ALL SELECT coalesce(w.cluster_id, 's{n}:' || i.product_key), coalesce(c.ord, {n}), coalesce(c.sub, i.product_key), coalesce(w.score, 1.0::DOUBLE), i.* FROM i{n} i LEFT JOIN w{n} w USING (product_key) LEFT JOIN c{n} c ON c.cluster_id = w.cluster_id)"""


ROUNDS = MATCHED + round_of(1, "US FOOD") + round_of(2, "KOHL") + """,
disp2 AS (SELECT cluster_id, arg_min(product_name, (length(product_name), lower(product_name), product_name)) AS name FROM m2 GROUP BY cluster_id)"""

RESOLVED = SAME + f""", byname AS (SELECT store, {key('product_name')} AS norm, min(product_key) AS k FROM cat GROUP BY 1, 2 HAVING norm <> ''),
m AS (SELECT *, {clean('ref')} AS r FROM {{manual_rows}}),
res AS (SELECT m.manual_ord, m.product_name, m.store_pos, m.store, coalesce(a.product_key, b.k) AS product_key FROM m LEFT JOIN cat a ON a.store = m.store AND a.product_key = r LEFT JOIN byname b ON b.store = m.store AND b.norm = {key('r')} WHERE r <> '' AND coalesce(a.product_key, b.k) IS NOT NULL),
resolved AS (SELECT res.*, cat.product_name AS item_name, cat.price FROM res JOIN cat ON cat.store = res.store AND cat.product_key = res.product_key),
claimed AS (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY store, product_key ORDER BY manual_ord, store_pos) = 1)"""

# the fragments view has one page an order: lines at the rows' y, cells by their known places
LINES = """w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, end_x, text) AS rn FROM {fragments}),
fold AS (SELECT doc_id, page, rn, text, x, end_x, y, y AS line_y, 0 AS line_no FROM w WHERE rn = 1
  UNION ALL SELECT w.doc_id, w.page, w.rn, w.text, w.x, w.end_x, w.y, CASE WHEN w.y - f.line_y > 2.5 THEN w.y ELSE f.line_y END, CASE WHEN w.y - f.line_y > 2.5 THEN f.line_no + 1 ELSE f.line_no END
  FROM fold f JOIN w ON w.doc_id = f.doc_id AND w.page = f.page AND w.rn = f.rn + 1)"""
CELLS = LINES + """, gap AS (SELECT *, CASE WHEN x - lag(end_x) OVER l > 6 THEN 1 ELSE 0 END AS far FROM fold WINDOW l AS (PARTITION BY doc_id, page, line_no ORDER BY x, end_x, text)),
num AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page, line_no ORDER BY x, end_x, text ROWS UNBOUNDED PRECEDING) AS cell_no FROM gap),
cells AS (SELECT doc_id, page, line_no, line_y, cell_no, string_agg(text, ' ' ORDER BY x, end_x, text) AS text, min(x) AS x, arg_max(end_x, (x, end_x, text)) AS end_x FROM num GROUP BY ALL)"""
HEADS = CELLS + """, hgap AS (SELECT *, CASE WHEN x - lag(end_x) OVER (PARTITION BY doc_id, page, line_no ORDER BY x) > 8 THEN 1 ELSE 0 END AS far FROM cells),
hnum AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page, line_no ORDER BY x ROWS UNBOUNDED PRECEDING) AS h FROM hgap),
heads AS (SELECT doc_id, page, line_no, line_y, h, string_agg(text, ' ' ORDER BY x) AS text, min(x) AS x, arg_max(end_x, x) AS end_x, lower(string_agg(text, ' ' ORDER BY x)) AS k FROM hnum GROUP BY ALL),
pair AS (SELECT p.doc_id, p.page, p.x AS p_x, p.end_x AS p_end, p.line_y AS p_y, r.x AS r_x, r.end_x AS r_end, r.line_y AS r_y, abs(p.line_y - r.line_y) + 3 * abs(p.line_no - r.line_no) AS score
  FROM heads p JOIN heads r ON p.doc_id = r.doc_id AND p.page = r.page
  WHERE p.line_y <= 0.48 * 792 AND r.line_y <= 0.48 * 792 AND (contains(p.k, 'product description') OR contains(p.k, 'product name') OR p.k IN ('description', 'item description')) AND (contains(r.k, 'price') OR contains(r.k, 'cost'))
    AND p.x < r.x AND abs(p.line_y - r.line_y) <= 32
  QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY score, p.line_no, p.h, r.line_no, r.h) = 1)"""
BOUNDS = HEADS + """, hrow AS (SELECT h.*, p_x, p_end, r_x, r_end FROM heads h JOIN pair USING (doc_id, page) WHERE abs(line_y - (p_y + r_y) / 2) <= 8),
spot AS (SELECT doc_id, page, arg_min({'x': x, 'e': end_x}, (x, line_no, h)) FILTER (contains(k, 'pack')) AS pack,
  coalesce(arg_min({'x': x, 'e': end_x}, (line_no, h)) FILTER (contains(k, 'upc')), arg_min({'x': x, 'e': end_x}, (line_no, h)) FILTER (k = 'item'), arg_min({'x': x, 'e': end_x}, (line_no, h)) FILTER (contains(text, '#') AND contains(k, 'product'))) AS ident FROM hrow GROUP BY ALL),
bounds AS (SELECT hrow.doc_id, hrow.page, max(line_y) + 4 AS header_bottom, coalesce(max(end_x) FILTER (end_x < p_x) + 4, greatest(0, any_value(p_x) - 40)) AS product_start,
  coalesce((any_value(p_end) + min(x) FILTER (x > p_end + 8)) / 2, any_value(r_x) - 24) AS product_end, any_value(r_x) - 32 AS price_start, coalesce(min(x) FILTER (x > r_end + 8) - 6, 'inf'::DOUBLE) AS price_end,
  CASE WHEN any_value(pack) IS NOT NULL THEN coalesce((max(end_x) FILTER (end_x < pack.x) + any_value(pack.x)) / 2, greatest(0, any_value(pack.x) - 40)) END AS pack_start,
  CASE WHEN any_value(pack) IS NOT NULL THEN coalesce((min(x) FILTER (x > pack.e) + any_value(pack.e)) / 2, 'inf'::DOUBLE) END AS pack_end,
  CASE WHEN any_value(ident) IS NOT NULL THEN coalesce((max(end_x) FILTER (end_x < ident.x) + any_value(ident.x)) / 2, greatest(0, any_value(ident.x) - 40)) END AS ident_start,
  CASE WHEN any_value(ident) IS NOT NULL THEN coalesce((min(x) FILTER (x > ident.e) + any_value(ident.e)) / 2, 'inf'::DOUBLE) END AS ident_end
  FROM hrow JOIN spot ON hrow.doc_id = spot.doc_id AND hrow.page = spot.page GROUP BY hrow.doc_id, hrow.page)"""
PRICES = BOUNDS + f""", pt AS (SELECT c.doc_id, c.page, line_no, line_y, string_agg(text, ' ' ORDER BY x, text) AS t FROM cells c JOIN bounds b ON c.doc_id = b.doc_id AND c.page = b.page WHERE line_y > header_bottom AND x >= price_start AND x < price_end GROUP BY ALL),
prows AS (SELECT doc_id, page, line_no, line_y AS y, CASE WHEN {price('t')} > 0 THEN {price('t')} END AS price, CASE WHEN {price('t')} > 0 THEN {unit('t')} ELSE '' END AS unit FROM pt WHERE {price('t')} > 0 OR contains({key('t')}, 'no price'))"""
WINDOWS = PRICES + """, g AS (SELECT doc_id, page, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, line_no) > 4 THEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, line_no) END AS gap FROM prows),
mid AS (SELECT *, median(gap) OVER (PARTITION BY doc_id, page) AS m FROM g),
win AS (SELECT doc_id, page, least(24.0, greatest(6.0, coalesce(median(gap) FILTER (gap >= m) * 0.45, 12.0)))::DOUBLE AS row_window FROM mid GROUP BY doc_id, page)"""


def near(name: str) -> str:
    return f"coalesce(string_agg(text, ' ' ORDER BY line_y, x, text) FILTER (x >= {name}_start AND x < {name}_end), '')"


ROWS = WINDOWS + f""", recs AS (SELECT r.doc_id, r.page, r.line_no, r.y, r.price, r.unit AS price_unit, {near('product')} AS product_name, {near('pack')} AS pack_size, regexp_extract({near('ident')}, '\\b\\d{{5,8}}\\b', 0) AS product_id
  FROM prows r JOIN win USING (doc_id, page) JOIN bounds b USING (doc_id, page) JOIN cells c USING (doc_id, page) WHERE c.line_y > header_bottom AND abs(c.line_y - r.y) <= row_window GROUP BY r.doc_id, r.page, r.line_no, r.y, r.price, r.unit HAVING product_name <> ''),
rec AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, line_no) AS rec_ord FROM recs)"""


def preferred(source: str) -> str:
    ident, pid = clean("product_id"), f"{key('product_name')} || '|' || {key('pack_size')}"
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN {ident} <> '' THEN {ident} ELSE {pid} END ORDER BY coalesce(price_unit = 'CS', false) DESC, rec_ord) = 1"


def distinguished(source: str) -> str:
    ident, q = clean("product_id"), f"coalesce(nullif(regexp_replace({clean('pack_size')}, '^1\\s+(\\S)', '\\1'), ''), 'Item ' || {clean('product_id')})"
    return f"""SELECT * EXCLUDE (norm, q, product_name), CASE WHEN count(*) OVER (PARTITION BY doc_id, norm) > 1 THEN {clean('product_name')} || ' [' || CASE WHEN count(*) OVER (PARTITION BY doc_id, norm, q) > 1 AND {ident} <> '' THEN q || ' · ' || {ident} ELSE q END || ']' ELSE product_name END AS product_name
  FROM (SELECT *, {key('product_name')} AS norm, {q} AS q FROM {source})"""


def grouped(source: str) -> str:
    return f"SELECT doc_id, {key('product_name')} AS product_key, {clean('product_name')} AS product_name, price FROM {source} WHERE product_key <> '' AND (price IS NULL OR price > 0) QUALIFY row_number() OVER (PARTITION BY doc_id, product_key ORDER BY price NULLS LAST, product_name) = 1"


POSITIONED = ROWS + f", pref AS ({preferred('rec')}), dist AS ({distinguished('pref')})"

JOINED = f"array_to_string(list_transform(list_filter(cells, lambda x: x <> ''), lambda x: {key('x')}), ' ')"
NORMAL = f"""c0 AS (SELECT doc_id, page, table_no, row_no, list_transform(cells, lambda x: {clean('x')}) AS cells FROM {{table_rows}}),
c1 AS (SELECT * FROM c0 WHERE len(list_filter(cells, lambda x: x <> '')) > 0),
norm AS (SELECT doc_id, page, table_no, row_no, list_resize(cells, max(len(cells)) OVER (PARTITION BY doc_id, page, table_no), '') AS cells FROM c1)"""
TABLES = NORMAL + f""", sc AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, table_no ORDER BY row_no) AS rk, {JOINED} AS j FROM norm WHERE len(cells) > 1),
pts AS (SELECT *, CASE WHEN j = '' THEN -999 ELSE CASE WHEN regexp_matches(j, 'product|description|item|name|line') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(j, 'price|cost') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(j, 'qty|pack|size|brand') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(j, '[0-9]') THEN 1 ELSE 0 END END AS score FROM sc),
hd AS (SELECT doc_id, page, table_no, row_no AS header_row, cells AS header FROM pts WHERE rk <= 8 AND score >= 4 QUALIFY row_number() OVER (PARTITION BY doc_id, page, table_no ORDER BY score DESC, row_no) = 1),
hn AS (SELECT doc_id, page, table_no, unnest(header) AS raw, generate_subscripts(header, 1) AS col_no FROM hd),
hb AS (SELECT *, CASE WHEN raw = '' THEN 'col_' || col_no ELSE raw END AS base FROM hn),
hnames AS (SELECT doc_id, page, table_no, col_no::INT AS col_no, CASE WHEN row_number() OVER (PARTITION BY doc_id, page, table_no, base ORDER BY col_no) = 1 THEN base ELSE base || '_' || row_number() OVER (PARTITION BY doc_id, page, table_no, base ORDER BY col_no) END AS name FROM hb),
body AS (SELECT n.*, header_row FROM norm n JOIN hd USING (doc_id, page, table_no) WHERE row_no > header_row AND cells <> header AND len(list_filter(cells, lambda x: x <> '')) > 1),
cs AS (SELECT *, {key('name')} AS k FROM hnames),
cp AS (SELECT *, CASE WHEN contains(k, 'product') THEN 6 ELSE 0 END + CASE WHEN contains(k, 'name') THEN 4 ELSE 0 END + CASE WHEN contains(k, 'description') THEN 3 ELSE 0 END + CASE WHEN contains(k, 'item') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(k, 'price|cost|qty') THEN 3 ELSE 0 END AS ps,
  CASE WHEN contains(k, 'price') THEN 7 ELSE 0 END + CASE WHEN contains(k, 'cost') THEN 5 ELSE 0 END + CASE WHEN contains(k, 'unit') THEN 2 ELSE 0 END - CASE WHEN contains(k, 'total') THEN 3 ELSE 0 END - CASE WHEN contains(k, 'qty') THEN 2 ELSE 0 END AS rs FROM cs),
cols AS (SELECT doc_id, page, table_no, arg_max(col_no, (ps, -col_no)) AS product_col, arg_max(col_no, (rs, -col_no)) AS price_col FROM cp GROUP BY ALL HAVING max(ps) > 0 AND max(rs) > 0),
extracted AS (SELECT doc_id, page, table_no, row_no, cells[product_col] AS product_name, {cast("regexp_extract(replace(cells[price_col], ',', ''), '(-?\\d+(?:\\.\\d+)?)', 1)")} AS price FROM body JOIN cols USING (doc_id, page, table_no) WHERE product_name <> '' AND price IS NOT NULL)"""
ONE = NORMAL + f""", tl AS (SELECT doc_id, page, cells[1] AS line FROM norm WHERE len(cells) = 1), tr1 AS ({list_lines('tl', 'doc_id, page')}),
pl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line FROM {{page_text}}), lr AS ({list_lines('pl', 'doc_id, page')})"""
FIRST_HIT = """, fp AS (SELECT l.doc_id, min(l.page) AS page FROM lr l GROUP BY l.doc_id HAVING min(l.page) < coalesce((SELECT min(page) FROM tr1 t WHERE t.doc_id = l.doc_id), 999999)),
single AS (SELECT * FROM tr1 UNION ALL SELECT lr.* FROM lr SEMI JOIN fp USING (doc_id, page))"""

SHEET_VALUES = f"""v AS (SELECT row_ord, {relation('nombre_producto')} AS g, {relation('nombre_sysco')} AS a, {relation('nombre_kohl')} AS b, {relation('nombre_usfood')} AS c FROM {{standard_sheet}})"""
TO_MANUAL = f"""WITH {SHEET_VALUES} SELECT row_ord AS manual_ord, coalesce(nullif(g, ''), nullif(a, ''), nullif(b, ''), c) AS product_name, store_pos, store, ref
FROM (SELECT *, unnest([{{'store_pos': 0, 'store': 'SYSCO', 'ref': a}}, {{'store_pos': 1, 'store': 'KOHL', 'ref': b}}, {{'store_pos': 2, 'store': 'US FOOD', 'ref': c}}], recursive := true) FROM v) WHERE ref <> ''"""

DOC_PROVIDER = f"""dp AS (SELECT doc_id, arg_min({provider('left(text, 4000)')}, page) FILTER ({provider('left(text, 4000)')} IS NOT NULL) AS p FROM {{list_pages}} WHERE page <= 2 GROUP BY doc_id),
lp AS (SELECT list_ord, coalesce({provider("regexp_extract(path, '[^/]*$', 0)")}, p, 'SYSCO') AS provider FROM {{lists}} LEFT JOIN dp USING (doc_id))"""


def store_names(lists: str, pages: str) -> str:
    """sn: list_ord, doc_id and unique_name of the accepted lists; a blank name is the provider's, or a request for one."""
    given = f"coalesce(nullif({clean('list_name')}, ''), provider)"
    return f"""acc AS (SELECT * FROM {lists} WHERE suffix(lower(path), '.pdf') QUALIFY row_number() OVER (PARTITION BY path ORDER BY list_ord) = 1),
{DOC_PROVIDER.replace("{lists}", "acc").replace("{list_pages}", pages)},
nm AS (SELECT list_ord, doc_id, CASE WHEN {clean('list_name')} = '' AND provider = 'SYSCO' AND list_ord > min(list_ord) FILTER (upper({given}) = 'SYSCO') OVER () THEN 'ENTER SUPPLIER NAME' ELSE {given} END AS base FROM acc JOIN lp USING (list_ord)),
sn AS (SELECT list_ord, doc_id, base || CASE WHEN k = 1 THEN '' ELSE '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY list_ord) AS k FROM nm))"""


CASCADE = (f"{POSITIONED}, pos AS ({grouped('dist')}), {TABLES}{ONE.removeprefix(NORMAL)}{FIRST_HIT}".replace("{table_rows}", "{cascade_rows}").replace("{page_text}", "{cascade_text}")
    + f""", every AS (SELECT doc_id, product_name, price, 1 AS way FROM pos UNION ALL SELECT doc_id, product_name, price, 2 FROM extracted UNION ALL SELECT doc_id, product_name, price, 3 FROM single),
first_way AS (SELECT doc_id, min(way) AS way FROM every GROUP BY doc_id), kept_rows AS (SELECT every.* FROM every SEMI JOIN first_way USING (doc_id, way)), grp AS ({grouped('kept_rows')})""")

# the rows of the usual table of subsequence lengths, one for each character of b, made cell by cell
LCS = """list_reduce(list_prepend(list_transform(range(length(a) + 1), lambda i: 0), list_transform(string_split(b, ''), lambda c: [ascii(c)])), lambda row, x:
  list_reduce(list_prepend([0], list_transform(range(1, length(a) + 1), lambda j: [j::INT])), lambda done, j: list_append(done, CASE WHEN ascii(a[j[1]]) = x[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], done[j[1]]) END)))"""

SQL = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "normalize_key": f"SELECT doc_id, {key('text')} AS norm FROM documents",
    "to_numeric": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(regexp_extract(replace('$ ' || format('{:,.2f}', l_extendedprice) || ' ' || l_returnflag, ',', ''), '(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS amount FROM lineitem",
    "price_candidate": f"SELECT doc_id, text, x, y, {price('text')} AS price, CASE WHEN {price('text')} IS NOT NULL THEN {unit('text')} END AS unit FROM {{fragments}}",
    "single_line_parse": f"WITH l AS (SELECT *, text AS line FROM {{page_text}}), p AS ({list_lines('l', 'doc_id, page, text')}) SELECT l.doc_id, l.page, l.text, product_name, price FROM l LEFT JOIN (SELECT DISTINCT * FROM p) p ON l.doc_id = p.doc_id AND l.page = p.page AND l.text = p.text",
    "provider_detect": f"SELECT doc_id, {provider("concat_ws(' ', source, CASE doc_id % 3 WHEN 0 THEN 'US  Foods' WHEN 1 THEN 'KOHL''s' END, text)")} AS provider FROM documents",
    "relation_value": f"SELECT row_ord, {relation('nombre_producto')} AS nombre_producto, {relation('nombre_sysco')} AS nombre_sysco, {relation('nombre_kohl')} AS nombre_kohl, {relation('nombre_usfood')} AS nombre_usfood FROM {{standard_sheet}}",
    "product_id": r"SELECT doc_id, regexp_extract(text, '\b\d\d\d\d\d\d?\d?\d?\b', 0) AS product_id FROM documents",
    "header_predicates": f"SELECT p_partkey, contains(k, 'product description') OR contains(k, 'product name') OR k IN ('description', 'item description') AS product_header, contains(k, 'price') OR contains(k, 'cost') AS price_header FROM (SELECT p_partkey, {key("CASE p_size % 4 WHEN 0 THEN 'Item Description' WHEN 1 THEN 'Unit Cost ' || p_brand WHEN 2 THEN p_name || ' product-name' ELSE p_name END")} AS k FROM part)",
    "valid_price": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber > 2 AND l_extendedprice - 20000 > 0 THEN l_extendedprice - 20000 END AS price FROM lineitem",
    "intake_filter": "SELECT list_ord, path, CASE WHEN suffix(lower(path), '.pdf') AND row_number() OVER (PARTITION BY path ORDER BY list_ord) = 1 THEN 'added' ELSE 'skipped' END AS status FROM {lists}",
    "default_names": f"SELECT list_ord, coalesce(nullif({clean('list_name')}, ''), CASE list_ord WHEN 0 THEN 'sysco' WHEN 1 THEN 'us food' WHEN 2 THEN 'kohls' ELSE 'listing_' || (list_ord + 1) END) AS store FROM {{lists}}",
    "unique_names": f"WITH b AS (SELECT list_ord, coalesce(nullif({clean('list_name')}, ''), 'listing') AS base FROM {{lists}}), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY list_ord) AS k FROM b) SELECT list_ord, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS unique_name FROM k",
    "provider_detect_doc": f"WITH {DOC_PROVIDER} SELECT list_ord, provider FROM lp",
    "suggest_names": f"WITH {DOC_PROVIDER} SELECT list_ord, CASE WHEN provider = 'SYSCO' AND count(*) FILTER (provider = 'SYSCO') OVER (ORDER BY list_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'ENTER SUPPLIER NAME' ELSE provider END AS suggested FROM lp",
    "store_names": f"WITH {store_names('{lists}', '{list_pages}')} SELECT list_ord, unique_name FROM sn",
    "output_names": "WITH n AS (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 5 = 0 THEN p_name || '.XLSX' WHEN p_partkey % 7 = 0 THEN '' ELSE ' ' || p_name END, '\\s+', ' ', 'g')) AS n FROM part) SELECT p_partkey, CASE WHEN n = '' THEN 'price_comparison.xlsx' WHEN suffix(lower(n), '.xlsx') THEN n ELSE n || '.xlsx' END AS output FROM n",
    "job_log": "WITH RECURSIVE " + CASCADE.replace("{fragments}", "{many_fragments}").replace("{cascade_rows}", "{many_rows}").replace("{cascade_text}", "{many_text}") + f""", {store_names('{many_lists}', '{many_text}')},
found AS (SELECT doc_id, count(*) AS n, any_value(way) AS way FROM grp JOIN first_way USING (doc_id) GROUP BY doc_id)
SELECT unique_name AS store, list_ord AS store_ord, coalesce(n, 0) AS product_count, CASE way WHEN 3 THEN 'single-column' WHEN 2 THEN 'tabular' WHEN 1 THEN 'tabular' END AS source_format, CASE WHEN n > 0 THEN 'ok' ELSE 'failed' END AS status FROM sn LEFT JOIN found USING (doc_id)""",
    "signature": f"SELECT list_ord % 5 AS run, sha1(string_agg(l, chr(10) ORDER BY l)) AS signature FROM (SELECT list_ord, upper({clean('list_name')}) || '|' || lower(path) AS l FROM {{lists}}) GROUP BY 1",
    "ingestion_log": f"WITH {CAT}, s AS (SELECT DISTINCT upper({clean('list_name')}) AS store FROM {{lists}}) SELECT s.store, count(cat.store) AS product_count, CASE WHEN count(cat.store) > 0 THEN 'ok' ELSE 'failed' END AS status FROM s LEFT JOIN cat USING (store) GROUP BY s.store",
    "run_summary": f"WITH {SAME} SELECT true AS ok, (SELECT count(DISTINCT store) FROM {{same_listings}}) AS store_count, (SELECT count(DISTINCT product_key) FROM cat WHERE price > 0) AS product_count",
    "features": f"WITH {features(False)} SELECT n.product_name, coalesce(canonical_text, '') AS canonical_text, {joined('tokens')}, {joined('strong')}, {joined('numbers')}, {joined('categories')}, {joined('states')} FROM names n LEFT JOIN f ON n.product_name = f.product_name LEFT JOIN s ON n.product_name = s.product_name",
    "features_legacy": f"WITH {features(True)} SELECT n.product_name, coalesce(canonical_text, '') AS canonical_text, {joined('strong')}, {joined('numbers')} FROM names n LEFT JOIN f ON n.product_name = f.product_name",
    "state_conflict": "SELECT p_partkey, p_size % 3 <> p_partkey % 3 AND (p_size % 3 = 0 OR p_partkey % 3 = 0) AS conflict FROM part",
    "token_overlap": OVERLAP + """ SELECT a.product_name AS a_name, b.product_name AS b_name, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) AS jaccard,
  len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens)) AS containment, len(list_intersect(coalesce(a.strong, []), coalesce(b.strong, []))) / greatest(1, least(len(coalesce(a.strong, [])), len(coalesce(b.strong, [])))) AS strong_overlap
  FROM u a JOIN u b ON a.store = 'SYSCO' AND b.store = 'KOHL' AND a.num = b.num""",
    "line_groups": f"WITH RECURSIVE {LINES} SELECT doc_id, page, line_no, line_y, count(*) AS n_fragments FROM fold GROUP BY ALL",
    "line_cells": f"WITH RECURSIVE {CELLS} SELECT doc_id, page, line_y, text, x, end_x FROM cells",
    "line_text": f"WITH RECURSIVE {CELLS} SELECT doc_id, page, line_y, string_agg(text, ' ' ORDER BY x) AS text FROM cells GROUP BY ALL",
    "header_pair": f"WITH RECURSIVE {HEADS} SELECT doc_id, page, p_x, p_end, p_y, r_x, r_y, score FROM pair",
    "column_bounds": f"WITH RECURSIVE {BOUNDS} SELECT * FROM bounds",
    "price_rows": f"WITH RECURSIVE {PRICES} SELECT doc_id, page, y, price, unit FROM prows",
    "row_window": f"WITH RECURSIVE {WINDOWS} SELECT * FROM win",
    "row_text": f"WITH RECURSIVE {ROWS} SELECT doc_id, product_name, price, price_unit, pack_size, product_id FROM rec",
    "positioned": f"WITH RECURSIVE {POSITIONED} {grouped('dist')}",
    "case_prices": preferred("{records}"),
    "disambiguate": distinguished("{records}"),
    "group_records": grouped("{records}"),
    "table_normalize": f"WITH {NORMAL} SELECT doc_id, row_no, array_to_string(cells, '|') AS cells FROM norm",
    "table_header": f"WITH {TABLES} SELECT * FROM hnames",
    "table_body": f"WITH {TABLES} SELECT doc_id, table_no, row_no, array_to_string(cells, '|') AS cells FROM body",
    "table_columns": f"WITH {TABLES} SELECT * FROM cols",
    "table_extract": f"WITH {TABLES} SELECT * FROM extracted",
    "single_column": f"WITH {ONE}{FIRST_HIT} SELECT * FROM single",
    "single_column_all_pages": f"WITH {ONE} SELECT * FROM tr1 UNION ALL SELECT * FROM lr",
    "parse_cascade": f"WITH RECURSIVE {CASCADE} SELECT grp.*, CASE way WHEN 3 THEN 'single-column' ELSE 'tabular' END AS source_format FROM grp JOIN first_way USING (doc_id)",
    "lcs_ratio": OVERLAP + f""", p AS (SELECT x.product_name AS a_name, y.product_name AS b_name, x.canonical_text AS a, y.canonical_text AS b FROM u x JOIN u y ON x.store = 'SYSCO' AND y.store = 'KOHL' AND x.num = y.num),
t AS (SELECT a, b, CASE WHEN a = b THEN 1 ELSE 2 * {LCS}[length(a) + 1] / (length(a) + length(b)) END::DOUBLE AS ratio FROM (SELECT DISTINCT a, b FROM p))
SELECT a_name, b_name, ratio FROM p JOIN t USING (a, b)""",
    "catalog": f"WITH {CAT} SELECT * FROM cat",
    "lookup_name": f"WITH {CAT} SELECT store, {key('product_name')} AS norm_name, min(product_key) AS product_key FROM cat GROUP BY 1, 2 HAVING norm_name <> ''",
    "manual_resolve": f"WITH {RESOLVED} SELECT manual_ord, store_pos, store, product_key, item_name, price FROM resolved",
    "manual_claim": f"WITH {RESOLVED} SELECT 'm' || manual_ord AS cluster_id, store, product_key, item_name AS product_name, price, 1.0::DOUBLE AS score, 'manual' AS source FROM claimed",
    "remaining": f"WITH {RESOLVED} SELECT store, product_key, price FROM cat ANTI JOIN claimed USING (store, product_key)",
    "exact_key_match": f"WITH {SAME} SELECT b.store, b.product_key, 's0:' || a.product_key AS cluster_id, 1.0::DOUBLE AS score, 0.0::DOUBLE AS second FROM cat a JOIN cat b ON a.product_key = b.product_key AND a.store = 'SYSCO' AND b.store = 'KOHL'",
    "display_name": "SELECT string_split(product_name, ' ')[1] AS cluster_id, arg_min(product_name, (length(product_name), lower(product_name), product_name)) AS display_name FROM {listings} GROUP BY 1",
    "comparison_exact": f"WITH {EXACT} SELECT {key('any_value(name)')} AS product_key, any_value(name) AS \"Product\", {pivot('price')} FROM cat JOIN disp ON cat.product_key = cluster_id GROUP BY cluster_id HAVING max(price) > 0",
    "relations_wide": f"WITH {EXACT} SELECT any_value(name) AS \"Product\", 'auto' AS \"Match Source\", " + ", ".join(f"max(product_name) FILTER (store = '{s}') AS \"{s} Product\", max(price) FILTER (store = '{s}') AS \"{s} Price\", max(1.0::DOUBLE) FILTER (store = '{s}') AS \"{s} Score\"" for s in ("SYSCO", "US FOOD", "KOHL")) + " FROM cat JOIN disp ON cat.product_key = cluster_id GROUP BY cluster_id",
    "ranking": f"WITH {SAME}, p AS (SELECT *, min(price) OVER (PARTITION BY product_key) AS low FROM cat WHERE price > 0) SELECT s AS \"Store\", count(p.store) AS \"Products with best price\" FROM (VALUES ('SYSCO'), ('US FOOD'), ('KOHL')) v(s) LEFT JOIN p ON p.store = s AND abs(price - low) < 1e-9 GROUP BY s",
    "price_position": f"""WITH {SAME}, p AS (SELECT product_key AS cluster_id, store, price, min(price) OVER w AS low, max(price) OVER w AS high FROM cat WHERE price > 0 WINDOW w AS (PARTITION BY product_key)),
r AS (SELECT *, CASE WHEN high = low THEN 0.0::DOUBLE ELSE (price - low) / (high - low) END AS ratio FROM p)
SELECT cluster_id, store, price, ratio, round_even(ratio * 10, 0)::INT AS step, ['FF00C800', 'FF1ACE1A', 'FF33D333', 'FF4CD84C', 'FF66DE66', 'FF80E480', 'FF99E999', 'FFB2EEB2', 'FFCCF4CC', 'FFE6FAE6', 'FFFFFFFF'][round_even(ratio * 10, 0)::INT + 1] AS color, abs(price - low) < 1e-9 AS is_best FROM r""",
    "best_flag": f"WITH {SAME} SELECT product_key AS cluster_id, store, price FROM cat WHERE price > 0 QUALIFY abs(price - min(price) OVER (PARTITION BY product_key)) < 1e-9",
    "search": f"SELECT doc_id FROM documents WHERE contains({key('text')}, 'of the')",
    "options_sorted": f"WITH {CAT} SELECT store, product_key, product_name, row_number() OVER (PARTITION BY store ORDER BY lower(product_name), product_key)::INT AS place FROM cat",
    "editor_price": f"WITH {SAME} SELECT manual_ord, m.store, {clean('ref')} AS product_key, CASE WHEN price > 0 THEN '$' || format('{{:,.2f}}', price) ELSE '' END AS price_text FROM {{manual_rows}} m LEFT JOIN cat ON cat.store = m.store AND cat.product_key = {clean('ref')}",
    "best_candidates_equal": f"WITH {MATCHED}{round_of(1, 'KOHL')} SELECT 'KOHL' AS store, * FROM b1",
    "assignment_equal": f"WITH {MATCHED}{round_of(1, 'US FOOD')} SELECT 'US FOOD' AS store, * FROM w1",
    "comparison_equal": f"WITH {ROUNDS} SELECT {key('any_value(name)')} AS product_key, any_value(name) AS \"Product\", {pivot('price')} FROM m2 JOIN disp2 USING (cluster_id) GROUP BY cluster_id HAVING max(price) > 0",
    "ranking_equal": f"WITH {ROUNDS}, p AS (SELECT *, min(price) OVER (PARTITION BY cluster_id) AS low FROM m2 WHERE price > 0) SELECT s AS \"Store\", count(p.store) AS \"Products with best price\" FROM (VALUES ('SYSCO'), ('US FOOD'), ('KOHL')) v(s) LEFT JOIN p ON p.store = s AND abs(price - low) < 1e-9 GROUP BY s",
    "relations_equal": f"WITH {ROUNDS} SELECT any_value(name) AS \"Product\", 'auto' AS \"Match Source\", " + ", ".join(f"max(product_name) FILTER (store = '{s}') AS \"{s} Product\", max(price) FILTER (store = '{s}') AS \"{s} Price\", round(max(score) FILTER (store = '{s}'), 4) AS \"{s} Score\"" for s in ("SYSCO", "US FOOD", "KOHL")) + " FROM m2 JOIN disp2 USING (cluster_id) GROUP BY cluster_id",
    "pair_similarity": f"WITH {features(False, '{name_pairs_names}')}, x AS {featured('names')} SELECT a_name, b_name, {score(False)} AS score FROM {{name_pairs}} p JOIN x a ON a.product_name = a_name JOIN x b ON b.product_name = b_name",
    "pair_similarity_legacy": f"WITH {features(True, '{name_pairs_names}')}, x AS {featured('names')} SELECT a_name, b_name, {score(True)} AS score FROM {{name_pairs}} p JOIN x a ON a.product_name = a_name JOIN x b ON b.product_name = b_name",
    "relation_rows": f"WITH {EXACT} SELECT any_value(name) AS product_name, 'auto' AS source, " + ", ".join(f"max(product_key) FILTER (store = '{s}') AS \"{s}_product_key\", max(price) FILTER (store = '{s}') AS \"{s}_price\"" for s in ("SYSCO", "US FOOD", "KOHL")) + " FROM cat JOIN disp ON cat.product_key = cluster_id GROUP BY cluster_id",
    "provider_map": f"""WITH s AS (SELECT list_ord AS ord, list_ord || ' ' || {clean('list_name')} AS store FROM {{lists}}), k AS (SELECT *, {provider_key('store')} AS p FROM s),
f AS (SELECT store, p FROM k WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p ORDER BY ord) = 1), free AS (SELECT p, row_number() OVER (ORDER BY o) AS n FROM (VALUES ('sysco', 0), ('kohl', 1), ('usfood', 2)) v(p, o) ANTI JOIN f USING (p)),
rest AS (SELECT store, row_number() OVER (ORDER BY ord) AS n FROM s ANTI JOIN f USING (store)) SELECT store, p AS provider FROM f UNION ALL SELECT store, p FROM rest JOIN free USING (n)""",
    "standard_to_manual": TO_MANUAL,
    "provider_to_manual": TO_MANUAL,
    "legacy_to_manual": f"""WITH {SHEET_VALUES} SELECT row_ord AS manual_ord, coalesce(nullif(g, ''), nullif(a, ''), b) AS product_name, store_pos, store, ref
FROM (SELECT *, unnest([{{'store_pos': 0, 'store': 'North', 'ref': a}}, {{'store_pos': 1, 'store': 'South', 'ref': b}}], recursive := true) FROM v) WHERE ref <> ''""",
    "to_standard": f"WITH {SHEET_VALUES} SELECT coalesce(nullif(g, ''), nullif(a, ''), c) AS nombre_producto, a AS nombre_sysco, '' AS nombre_kohl, c AS nombre_usfood FROM v",
    "manual_to_standard": f"""WITH m AS (SELECT *, {relation('ref')} AS r, {relation('product_name')} AS g FROM {{manual_rows}}),
w AS (SELECT manual_ord, any_value(g) AS g, max(r) FILTER (store = 'SYSCO') AS a, max(r) FILTER (store = 'KOHL') AS b, max(r) FILTER (store = 'US FOOD') AS c FROM m GROUP BY manual_ord HAVING max(r) <> '')
SELECT manual_ord, coalesce(nullif(g, ''), nullif(a, ''), nullif(b, ''), c) AS nombre_producto, a AS nombre_sysco, b AS nombre_kohl, c AS nombre_usfood FROM w""",
    "display_headers": 'SELECT nombre_producto AS "COMMON NAME", nombre_sysco AS "SYSCO", nombre_kohl AS "KOHL", nombre_usfood AS "US FOODS" FROM {standard_sheet}',
    "merge_dedupe": f"""WITH a AS (SELECT 0 AS source_rank, * FROM {{manual_rows}} WHERE store <> 'KOHL' OR ref <> 'N/A' UNION ALL SELECT 1, manual_ord, product_name, store_pos, store, CASE WHEN manual_ord % 2 = 0 THEN ref ELSE ' ' || upper(ref) END FROM {{manual_rows}}),
g AS (SELECT source_rank, manual_ord, {clean('any_value(product_name)')} AS product_name, string_agg(store || '=' || {clean('ref')}, ';' ORDER BY store) AS stores, count(*) AS n FROM a GROUP BY 1, 2)
SELECT source_rank, manual_ord, product_name, stores FROM g WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY stores ORDER BY source_rank, manual_ord) = 1""",
    "duplicate_claims": f"SELECT store, {clean('ref')} AS product_key, list_sort(list(DISTINCT manual_ord))[1] AS first_row, list_sort(list(DISTINCT manual_ord))[2] AS second_row FROM {{manual_rows}} GROUP BY 1, 2 HAVING count(DISTINCT manual_ord) > 1",
    "editor_rows": f"""WITH {SAME}, j AS (SELECT m.manual_ord, m.product_name AS given, store_pos, cat.product_name AS item FROM {{manual_rows}} m LEFT JOIN cat ON cat.store = m.store AND cat.product_key = {clean('ref')} WHERE {clean('ref')} <> ''),
g AS (SELECT manual_ord, {clean('any_value(given)')} AS given, arg_min(item, store_pos) FILTER (item IS NOT NULL) AS fallback, count(*) AS n_stores FROM j GROUP BY 1)
SELECT manual_ord, coalesce(nullif(given, ''), nullif({clean('fallback')}, ''), 'group_' || row_number() OVER (ORDER BY manual_ord)) AS product_name, n_stores FROM g""",
    "saved_json": f"""WITH m AS (SELECT sha1((manual_ord % 7)::VARCHAR) AS signature, * FROM {{manual_rows}})
SELECT signature, (dense_rank() OVER (PARTITION BY signature ORDER BY manual_ord) - 1)::INT AS manual_ord, {clean('product_name')} AS product_name, (row_number() OVER (PARTITION BY manual_ord ORDER BY store) - 1)::INT AS store_pos, store, {clean('ref')} AS ref FROM m""",
    "saved_lines": f"""SELECT sha1((manual_ord % 7)::VARCHAR) AS signature, manual_ord, {clean('product_name')} AS product_name, (row_number() OVER (PARTITION BY manual_ord ORDER BY store) - 1)::INT AS store_pos, store, {clean('ref')} AS ref FROM {{manual_rows}}""",
    "read_checked": "SELECT CASE WHEN p_partkey % 10 NOT IN (3, 4) THEN p_partkey::VARCHAR END AS product_key, CASE WHEN p_partkey % 10 NOT IN (3, 4) THEN p_size + 0.5::DOUBLE END AS price, CASE WHEN p_partkey % 10 IN (3, 4) THEN line END AS raw FROM {listing_lines} JOIN {part} USING (p_partkey)",
    "chosen_sheet": """WITH s AS (SELECT manual_ord % 4 AS workbook, CASE WHEN store_pos = 1 AND manual_ord % 4 < 2 THEN 'Cuadro_Relaciones' WHEN store_pos = 2 AND manual_ord % 4 = 1 THEN 'Relations' ELSE 'Sheet' || store_pos END AS sheet_name, store_pos AS sheet_ord, manual_ord, ref FROM {manual_rows}),
b AS (SELECT workbook, arg_min(sheet_name, (CASE sheet_name WHEN 'Relations' THEN 0 WHEN 'Cuadro_Relaciones' THEN 1 ELSE 2 END, sheet_ord)) AS sheet_name FROM s GROUP BY 1) SELECT s.* FROM s SEMI JOIN b USING (workbook, sheet_name)""",
}
