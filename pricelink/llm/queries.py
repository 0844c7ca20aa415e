"""The queries opN_<name> on the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, langid, licenses, lm_score, merkle, mixing, quality, runs, sharding, simhash, substring, urlfilter
from .common import written

RANKS = "byte_bpe_50k.tiktoken"
N_SHARDS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path(RANKS), "pattern": public_tokenizers.PATTERN}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_folders(documents(spark, sf_dir)), licenses.templates(spark))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identified(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(documents(spark, sf_dir), lm_score.good_documents(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_files()
    back = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), **files), **files)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy does, from the written ledger alone."""
    return quality.ablation(written(quality.ledger(documents(spark, sf_dir)), "ledger"), "v1")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal(F.get("lanes", F.lit(0))).alias("fingerprint"), "component_id")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judged(pages, urlfilter.policy(spark))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.with_planted_runs(documents(spark, sf_dir)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(documents(spark, sf_dir), merkle.without_line_ends())


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_langid": op7_langid,
    "op8_urlfilter": op8_urlfilter,
    "op9_simhash": op9_simhash,
    "op10_lm_score": op10_lm_score,
    "op11_runs": op11_runs,
    "op12_merkle": op12_merkle,
    "op13_substring": op13_substring,
    "quality_ablation": quality_ablation,
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Every part against every template, without any bound.
LICENSES = r"""
WITH tpl(license, statement) AS (VALUES TEMPLATES),
tt AS (SELECT license, statement, unnest(regexp_extract_all(translate(statement, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:\.[0-9]+)*')) AS token FROM tpl),
tc AS (SELECT license, statement, token, count(*) AS tf FROM tt GROUP BY ALL),
idf AS (SELECT token, ln((1 + (SELECT count(*) FROM tpl))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tc GROUP BY token),
ts AS (SELECT license, statement, sqrt(sum((tf * idf) * (tf * idf))) AS size FROM tc JOIN idf USING (token) GROUP BY ALL),
tw AS (SELECT token, license, statement, tf * idf / size AS w FROM tc JOIN idf USING (token) JOIN ts USING (license, statement)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(doc_id, 0) AS k, coalesce(source, '') AS top, coalesce(lang, '') AS l FROM documents),
f AS (SELECT r, doc_id, t, CASE WHEN k % 7 = 0 THEN top WHEN k % 7 <= 2 THEN top || '/' || l ELSE top || '/' || l || '/' || floor(k / 1000)::BIGINT END AS folder FROM d),
e0 AS (SELECT r, unnest(string_split_regex(t, '\n|[.!?][ \t]+')) AS x, generate_subscripts(string_split_regex(t, '\n|[.!?][ \t]+'), 1) AS i FROM f),
e1 AS (SELECT r, i, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:\.[0-9]+)*') AS w FROM e0),
e AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) AS i, w FROM e1 WHERE len(w) > 0),
u AS (SELECT r, 0 AS kind, w FROM e UNION ALL SELECT a.r, 1, a.w || b.w FROM e a JOIN e b ON a.r = b.r AND b.i = a.i + 1 UNION ALL SELECT r, 2, flatten(list(w ORDER BY i)) FROM e GROUP BY r),
uu AS (SELECT r, kind, array_to_string(w, ' ') AS unit, len(w) AS size FROM u),
dist AS (SELECT row_number() OVER () AS id, unit FROM (SELECT DISTINCT unit FROM uu)),
uc AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(string_split(unit, ' ')) AS token FROM dist) GROUP BY ALL),
ux AS (SELECT id, uc.token, tf * coalesce(idf, ln((1.0 + (SELECT count(*) FROM tpl))::DOUBLE) + 1) AS x FROM uc LEFT JOIN idf USING (token)),
us AS (SELECT id, sqrt(sum(x * x)) AS size FROM ux GROUP BY id),
cs AS (SELECT id, license, round(sum(x * w) / any_value(us.size), 9) AS cosine FROM ux JOIN tw USING (token) JOIN us USING (id) GROUP BY id, license, statement),
best AS (SELECT unit, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM cs JOIN dist USING (id) GROUP BY unit HAVING max(cosine) >= 0.6::DOUBLE),
h AS (SELECT uu.r, kind, size, license, cosine FROM uu JOIN best USING (unit)),
n AS (SELECT r, max(size) AS n_words FROM uu WHERE kind = 2 GROUP BY r),
hd AS (SELECT r, coalesce(arg_min(license, (-cosine, license)) FILTER (kind = 2), arg_min(license, (-cosine, license)) FILTER (kind < 2)) AS license, coalesce(max(cosine) FILTER (kind = 2), max(cosine)) AS cosine,
  bool_or(kind = 2) OR greatest(coalesce(sum(size) FILTER (kind = 0), 0), coalesce(max(size) FILTER (kind = 1), 0)) >= 0.3::DOUBLE * any_value(n_words) AS is_file, count(*) FILTER (kind = 0) AS n_headers FROM h JOIN n USING (r) GROUP BY r),
lic AS (SELECT folder AS given_by, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM hd JOIN f USING (r) WHERE is_file GROUP BY folder),
up AS (SELECT folder, unnest(range(0, len(p) + 1)) AS depth, p FROM (SELECT DISTINCT folder, CASE WHEN folder = '' THEN [] ELSE string_split(folder, '/') END AS p FROM f)),
near AS (SELECT folder, arg_max(lic.license, depth) AS license, arg_max(lic.cosine, depth) AS cosine, arg_max(given_by, depth) AS given_by FROM up JOIN lic ON given_by = array_to_string(p[:depth], '/') GROUP BY folder)
SELECT doc_id, f.folder, CASE WHEN hd.r IS NULL THEN near.license ELSE hd.license END AS license, CASE WHEN hd.r IS NULL THEN near.cosine ELSE hd.cosine END AS cosine,
  CASE WHEN hd.is_file THEN 'file' WHEN hd.r IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, CASE WHEN hd.r IS NULL THEN given_by END AS given_by, coalesce(n_headers, 0)::BIGINT AS n_headers
FROM f LEFT JOIN hd USING (r) LEFT JOIN near USING (folder)
""".replace("TEMPLATES", ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licenses.HEADERS + licenses.TEXTS))

QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, range(5) AS k(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
ll AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN ll USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_letters >= 20 AND 10 * n_upper > 3 * n_letters THEN 8 ELSE 0 END
  + CASE WHEN n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 32 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality": QUALITY,
    "quality_ablation": f"""
SELECT rule, count(*) FILTER (failures & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failures = bit)::BIGINT AS n_only_this FROM ({QUALITY})
CROSS JOIN (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('upper_case', 8), ('repeated_lines', 16), ('word_length', 32)) p(rule, bit) GROUP BY rule
""",
    "op3_licenses": LICENSES,
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS place, count(*) OVER (PARTITION BY t) AS group_size,
  first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r
""",
    "op8_urlfilter": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  nullif(regexp_extract(rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.'), '(?:^|\.)((?:cheap-pills|free-bets|spam-farm|adult-x|casino-win|ads-track)\.example\.(?:com|net|org))$', 1), '') AS listed FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict, listed FROM r
""",
    "op12_merkle": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM documents),
f AS (SELECT r, doc_id, source, xor(crc, 4294967295) % 2 = 0 AS forged, text, concat(strlen(doc_id::VARCHAR), ':', doc_id) AS a, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END AS b,
  CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END AS c, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END AS e, replace(text, chr(10), '') AS cut FROM d),
l AS (SELECT r, doc_id, source, forged, sha256(concat(a, b, c, e, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
  sha256(concat(a, b, c, e, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(cut), ':', cut) END)) AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM f),
lv AS (SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM l GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], ''))) FROM lv WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tv AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM sub
  UNION ALL SELECT level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(nodes[3 * k + 1:3 * k + 3], ''))) FROM tv WHERE len(nodes) > 1),
w AS (SELECT r, source, 0 AS level, pos, CASE WHEN forged THEN other ELSE leaf END AS h, '' AS proof FROM l
  UNION ALL SELECT r, w.source, w.level + 1, pos // 3, sha256(concat(array_to_string(nodes[pos - pos % 3 + 1:pos], ''), h, array_to_string(nodes[pos + 2:pos - pos % 3 + 3], ''))),
  concat(proof, array_to_string(nodes[pos - pos % 3 + 1:pos], ''), array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '')) FROM w JOIN lv ON lv.source IS NOT DISTINCT FROM w.source AND lv.level = w.level AND len(nodes) > 1),
x AS (SELECT r, 0 AS level, sub.pos, h, proof FROM w JOIN lv ON lv.source IS NOT DISTINCT FROM w.source AND lv.level = w.level AND len(nodes) = 1 JOIN sub ON sub.source IS NOT DISTINCT FROM w.source
  UNION ALL SELECT r, x.level + 1, pos // 3, sha256(concat(array_to_string(nodes[pos - pos % 3 + 1:pos], ''), h, array_to_string(nodes[pos + 2:pos - pos % 3 + 3], ''))),
  concat(proof, array_to_string(nodes[pos - pos % 3 + 1:pos], ''), array_to_string(nodes[pos + 2:pos - pos % 3 + 3], '')) FROM x JOIN tv ON tv.level = x.level AND len(nodes) > 1)
SELECT l.doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = nodes[1] AS verified
FROM x JOIN tv ON tv.level = x.level AND len(nodes) = 1 JOIN l USING (r) JOIN sub ON sub.source IS NOT DISTINCT FROM l.source
""",
    "op13_substring": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT r, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
c AS (SELECT DISTINCT r, i + k AS i FROM f, range(50) AS k(k)),
x AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
""",
    "op10_lm_score": r"""
WITH good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL), FALSE) AS wanted,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, wanted, unnest(list_prepend('', w)) AS a, unnest(list_append(w, '')) AS b FROM d WHERE len(w) > 0),
p AS (SELECT r, wanted, a, b, count(*) AS n FROM t GROUP BY ALL),
u AS (SELECT r, b AS x, count(*) AS n FROM t GROUP BY ALL),
cp AS (SELECT a, b, sum(n) AS bg, sum(CASE WHEN wanted THEN n ELSE 0 END) AS tg FROM p GROUP BY ALL),
cw AS (SELECT b AS x, sum(n) AS bg, sum(CASE WHEN wanted THEN n ELSE 0 END) AS tg FROM p GROUP BY ALL),
m AS (SELECT sum(bg) AS bg, sum(tg) AS tg, count(*) - 1 AS v FROM cw),
s AS (SELECT r, sum(n) AS n FROM u GROUP BY r),
x AS (SELECT p.r, p.n, s.n AS tokens,
  CASE WHEN wanted THEN 1 ELSE 0 END AS own, cp.bg AS ab_b, cp.tg AS ab_t, ca.bg AS a_b, ca.tg AS a_t, cb.bg AS b_b, cb.tg AS b_t, ua.n AS own_a, ub.n AS own_b, m.bg AS m_b, m.tg AS m_t, m.v
  FROM p JOIN s USING (r) JOIN cp USING (a, b) JOIN cw ca ON ca.x = p.a JOIN cw cb ON cb.x = p.b JOIN u ua ON ua.r = p.r AND ua.x = p.a JOIN u ub ON ub.r = p.r AND ub.x = p.b CROSS JOIN m),
y AS (SELECT r, n, tokens, (b_b - own_b + 1)::DOUBLE / (m_b - tokens + v + 1)::DOUBLE AS one_b, (b_t - own * own_b + 1)::DOUBLE / (m_t - own * tokens + v + 1)::DOUBLE AS one_t,
  a_b - own_a AS left_b, a_t - own * own_a AS left_t, ab_b - n AS two_b, ab_t - own * n AS two_t FROM x),
l AS (SELECT r, tokens, sum(n * round(-ln(CASE WHEN left_b > 0 THEN 0.7::DOUBLE * (two_b::DOUBLE / left_b::DOUBLE) + (1 - 0.7::DOUBLE) * one_b ELSE one_b END) * 1e6)::BIGINT) AS lb,
  sum(n * round(-ln(CASE WHEN left_t > 0 THEN 0.7::DOUBLE * (two_t::DOUBLE / left_t::DOUBLE) + (1 - 0.7::DOUBLE) * one_t ELSE one_t END) * 1e6)::BIGINT) AS lt FROM y GROUP BY ALL),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, lt::DOUBLE / (1e6 * tokens::DOUBLE) AS target_loss, lb::DOUBLE / (1e6 * tokens::DOUBLE) AS background_loss FROM d LEFT JOIN l USING (r))
SELECT *, target_loss - background_loss AS score FROM f
""",
}
