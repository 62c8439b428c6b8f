"""The queries of this subpackage: name -> callable, and the oracle SQL where SQL can express one."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from parchment.llm import decontaminate, exact_dedup, html_extract, lattice_dedup, line_dedup, merkle_manifest, packing, periodic_runs, simhash, substring_dedup, token_counts, toxicity, url_filter
from parchment.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM first(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLES["op9_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS g
  FROM bw WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS g
  FROM dw, sizes WHERE len(ws) >= size),
hit AS (SELECT doc_id, pos, dwin.size, item_id FROM dwin JOIN win ON dwin.g = win.g AND dwin.size = win.size),
nh AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS w FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_budget(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "text", "n_lines", "n_removed")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_spans(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "text", "n_sentences", "n_removed")


@query
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_filter"] = r"""
WITH r(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fit AS (
  SELECT page_id, r.host || r.path AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND n = 1
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def with_repeats(doc: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, told by the CRC of its id, goes on from one of its words with a stretch repeated."""
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=with_repeats)
    # exact comparison of length / period: by cross products; runs come by start and period, so a tie keeps the earlier
    first = F.get("runs", F.lit(0))
    best = F.aggregate("runs", first, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * b.length div b.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli, "runs_sha256", "collapsed_sha256")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0
    found = merkle_manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", claims={"text": lower}, where=tampered)
    return found.withColumnRenamed("id", "doc_id")


def _sql_field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _sql_levels(name: str, of: str) -> str:
    """All nodes (g, lvl, pos, h) above those of ``of`` (g, pos, h), these included."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, h FROM {of} UNION ALL
  SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, lvl, pos // 16)"""


# DuckDB has no CRC: a byte is eight steps, in the first of which it is added
_SQL_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295)"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_sql_leaf("text")} AS h, CASE WHEN {_SQL_CRC} % 5 = 0 THEN {_sql_leaf(_LOWER)} END AS claim FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS pos FROM d),
{_sql_levels("lower_nodes", "leaf")},
sub AS (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS h FROM lower_nodes GROUP BY g),
name AS (SELECT g AS name, h, 'all' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM sub),
{_sql_levels("upper_nodes", "name")},
whole AS (SELECT max(lvl) AS top, arg_max(h, lvl) AS h FROM upper_nodes),
run AS (
  SELECT doc_id, l.g, l.pos AS own, u.lvl, u.pos, u.h, l.pos // CAST(power(16, u.lvl) AS BIGINT) AS here FROM leaf l JOIN lower_nodes u ON u.g = l.g AND u.pos // 16 = l.pos // CAST(power(16, u.lvl + 1) AS BIGINT) JOIN sub ON sub.g = l.g AND u.lvl < sub.top UNION ALL
  SELECT doc_id, l.g, l.pos, sub.top + u.lvl, u.pos, u.h, n.pos // CAST(power(16, u.lvl) AS BIGINT) FROM leaf l JOIN sub ON sub.g = l.g JOIN name n ON n.name = l.g JOIN upper_nodes u ON u.pos // 16 = n.pos // CAST(power(16, u.lvl + 1) AS BIGINT) JOIN whole ON u.lvl < whole.top),
proof AS (SELECT g, own, sha256(string_agg(h, '' ORDER BY lvl, pos)) AS proof_sha256 FROM run WHERE pos <> here GROUP BY g, own),
folded AS (
  SELECT g, pos AS own, 0 AS lvl, coalesce(claim, h) AS h FROM leaf UNION ALL
  SELECT f.g, f.own, f.lvl + 1, sha256(string_agg(CASE WHEN r.pos = r.here THEN f.h ELSE r.h END, '' ORDER BY r.pos)) FROM folded f JOIN run r ON r.g = f.g AND r.own = f.own AND r.lvl = f.lvl GROUP BY f.g, f.own, f.lvl),
ends AS (SELECT g, own, arg_max(h, lvl) AS folded_root FROM folded GROUP BY g, own)
SELECT l.doc_id, l.h AS leaf, sub.h AS subroot, whole.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = whole.h AS verified
FROM leaf l JOIN sub USING (g) JOIN ends e ON e.g = l.g AND e.own = l.pos LEFT JOIN proof p ON p.g = l.g AND p.own = l.pos CROSS JOIN whole
"""


@query
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.vector_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
