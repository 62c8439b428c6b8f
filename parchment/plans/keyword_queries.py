"""Queries of keyword extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import fixed_values as V
from parchment.operators import keywords as K
from parchment.plans import sql
from parchment.plans.registry import query
from parchment.session import ship
from parchment.sources.tables import table
from parchment.sources.token_store import stored


def docs(spark, d):
    return table(spark, d, "documents")


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STOP = f"""(length(term) <= 1 OR term IN ({_in(V.EN_STOPWORDS)}, {_in(V.KO_STOPWORDS)}) OR (term NOT IN ({_in(V.UNITS)}) AND (length(term) = 2 OR regexp_full_match(term, '[0-9]+') OR regexp_matches(term, '{V.FRAGMENTS[0]}', 'i') OR regexp_matches(term, '{V.FRAGMENTS[1]}', 'i'))))"""

BASE = f"""{sql.ITEMS},
ap AS (SELECT l.doc_id, l.page, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (trim(text) <> ''), '') AS concat FROM (SELECT *, CAST(pos // 5 + 1 AS INT) AS page FROM lines) l GROUP BY l.doc_id, l.page),
pt AS (SELECT doc_id, page, list_transform(regexp_extract_all(concat, '{sql.RE}'), lambda t: lower(t)) AS ts FROM ap),
tot AS (SELECT doc_id, count(*) AS n_pages, sum(len(ts)) AS n_tokens FROM pt GROUP BY doc_id),
tu AS (SELECT doc_id, page, unnest(range(len(ts))) AS i, unnest(ts) AS term FROM pt),
kt AS (SELECT * FROM tu WHERE NOT {STOP}),
seq AS (SELECT doc_id, page, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS BIGINT) AS n FROM kt),
tfdf AS (SELECT doc_id, term, count(*) AS tf, count(DISTINCT page) AS df, min(n) AS first FROM seq GROUP BY doc_id, term)"""

TFIDF = BASE + """,
raw AS (SELECT *, round(ln(1 + tf) * ln(1 + n_pages / df), 9) AS raw FROM tfdf JOIN tot USING (doc_id)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, first) AS INT) AS rank, max(raw) OVER (PARTITION BY doc_id) AS best FROM raw QUALIFY rank <= 20)"""

COLOR = "printf('hsl(%.1f, 70%%, 55%%)', ((rank - 1) * 137.5) % 360)"


@query("stopword_filter", f"WITH {BASE} SELECT DISTINCT term, {STOP} AS stop FROM tu")
def stopword_filter(spark, d):
    t = K.page_tokens(docs(spark, d)).select(F.explode("ts").alias("term")).distinct()
    return t.select("term", K.stopword(F.col("term")).alias("stop"))


@query("tf_df", f"WITH {BASE} SELECT doc_id, term, tf, df FROM tfdf")
def tf_df(spark, d):
    return K.tf_df(docs(spark, d)).select("doc_id", "term", "tf", "df")


_UNIT = f"CASE WHEN term IN ({_in(V.UNITS)}) THEN 'unit' END AS tag"


@query("kw_tfidf", f"WITH {TFIDF} SELECT doc_id, rank, term, round(raw / best, 6) AS score, tf AS frequency, round(tf / n_tokens * 100, 6) AS percent, {COLOR} AS color, {_UNIT} FROM top")
def kw_tfidf(spark, d):
    return K.tfidf(docs(spark, d))


@query("kw_pages", f"WITH {TFIDF} SELECT doc_id, term, (SELECT string_agg(page, ',' ORDER BY page) FROM (SELECT DISTINCT page FROM seq s WHERE s.doc_id = t.doc_id AND s.term = t.term)) AS pages FROM top t")
def kw_pages(spark, d):
    t = K.with_pages(K.tfidf(docs(spark, d)), docs(spark, d))
    return t.select("doc_id", "term", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("kw_contexts", rf"""WITH {TFIDF} SELECT t.doc_id, t.term, CAST(row_number() OVER w AS INT) AS k, i.page, i.item_index, left(i.text, 120) AS snippet FROM top t JOIN items i ON i.doc_id = t.doc_id
AND CASE WHEN regexp_full_match(term, '[A-Za-z0-9_]+') THEN regexp_matches(text, '(?i)\b' || term || '\b') ELSE contains(lower(text), term) END WINDOW w AS (PARTITION BY t.doc_id, t.term ORDER BY i.page, i.item_index) QUALIFY k <= 3""")  # fmt: skip
def kw_contexts(spark, d):
    return K.contexts(K.tfidf(docs(spark, d)), docs(spark, d))


COOC = BASE + """,
pr AS (SELECT doc_id, least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS w FROM seq x JOIN seq y USING (doc_id) WHERE y.n - x.n BETWEEN 1 AND 4 AND x.term <> y.term GROUP BY ALL)"""


@query("kw_cooccurrence", f"WITH {COOC} SELECT doc_id, a, b, w FROM pr")
def kw_cooccurrence(spark, d):
    return K.cooccurrence(docs(spark, d))


TEXTRANK = f"""{COOC}, e AS (SELECT doc_id, a AS s, b AS t, w FROM pr UNION ALL SELECT doc_id, b, a, w FROM pr), o AS (SELECT doc_id, s, sum(w) AS w FROM e GROUP BY ALL), en AS (SELECT e.doc_id, e.s, e.t, e.w / o.w AS p FROM e JOIN o ON o.doc_id = e.doc_id AND o.s = e.s),
nd AS (SELECT doc_id, term, count(*) OVER (PARTITION BY doc_id) AS n FROM tfdf),
r AS (SELECT doc_id, term, n, 1.0::DOUBLE / n AS r, 1.0::DOUBLE AS diff, 0 AS it FROM nd
  UNION ALL
  SELECT doc_id, term, n, r, sum(abs(r - old)) OVER (PARTITION BY doc_id) AS diff, it FROM (
    SELECT r.doc_id, r.term, r.n, r.r AS old, 0.15 / r.n + 0.85 * coalesce(f.s, 0) AS r, r.it + 1 AS it FROM r
    LEFT JOIN (SELECT en.doc_id, en.t, sum(en.p * r.r) AS s FROM r JOIN en ON en.doc_id = r.doc_id AND en.s = r.term GROUP BY ALL) f ON f.doc_id = r.doc_id AND f.t = r.term
    WHERE r.it < 30 AND r.diff >= 1e-4))"""


@query("kw_textrank", f"WITH RECURSIVE {TEXTRANK} SELECT doc_id, term, round(r, 6) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY it DESC) = 1")
def kw_textrank(spark, d):
    return K.textrank(docs(spark, d)).select("doc_id", "term", F.round("raw", 6).alias("rank"))


NGRAM = BASE + """,
gr AS (SELECT doc_id, n, 1 AS k, term AS g FROM seq UNION ALL SELECT doc_id, n, 2, term || ' ' || b FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM seq) WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, n, 3, term || ' ' || b || ' ' || c FROM (SELECT *, lead(term) OVER w AS b, lead(term, 2) OVER w AS c FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY n)) WHERE c IS NOT NULL),
gc AS (SELECT doc_id, k, g, count(*) AS frequency, min(n) AS n, count(*) * [1.0, 1.5, 2.0][k] AS raw FROM gr GROUP BY doc_id, k, g HAVING count(*) >= 2),
ga AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, k, n) AS pos FROM gc),
gk AS (SELECT * FROM ga x WHERE k > 1 OR NOT EXISTS (SELECT 1 FROM (SELECT doc_id, pos, unnest(string_split(g, ' ')) AS u FROM ga WHERE k > 1) y WHERE y.doc_id = x.doc_id AND y.u = x.g AND y.pos < x.pos))"""


@query("kw_ngram", f"WITH {NGRAM} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, k, n) AS INT) AS rank, g AS term, frequency, round(CAST(raw AS DOUBLE) / max(raw) OVER (PARTITION BY doc_id), 6) AS score FROM gk QUALIFY rank <= 20")
def kw_ngram(spark, d):
    return K.ngrams(docs(spark, d)).select("doc_id", "rank", "term", "frequency", F.round("score", 6).alias("score"))


RANKED = """gt AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, k, n) AS INT) AS rank, max(raw) OVER (PARTITION BY doc_id) AS best FROM gk QUALIFY rank <= 20)"""
TOP_GRAPH = TEXTRANK + """,
last AS (SELECT doc_id, term, round(r, 9) AS raw FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY it DESC) = 1),
gr20 AS (SELECT l.doc_id, l.term, f.tf, l.raw, CAST(row_number() OVER (PARTITION BY l.doc_id ORDER BY l.raw DESC, f.first) AS INT) AS rank, max(l.raw) OVER (PARTITION BY l.doc_id) AS best FROM last l JOIN tfdf f ON f.doc_id = l.doc_id AND f.term = l.term QUALIFY rank <= 20)"""


@query("kw_textrank_top", f"WITH RECURSIVE {TOP_GRAPH} SELECT g.doc_id, rank, term, round(raw / best, 6) AS score, tf AS frequency, round(tf / n_tokens * 100, 6) AS percent, {COLOR} AS color FROM gr20 g JOIN tot USING (doc_id)")
def kw_textrank_top(spark, d):
    return K.textrank_top(docs(spark, d))


@query("kw_all", f"WITH RECURSIVE {TOP_GRAPH}, {NGRAM[len(BASE) + 1:].strip()}, {RANKED}, {TFIDF[len(BASE) + 1:].strip()} SELECT doc_id, 'tfidf' AS algorithm, rank, term FROM top UNION ALL SELECT doc_id, 'ngram', rank, g FROM gt UNION ALL SELECT doc_id, 'textrank', rank, term FROM gr20")
def kw_all(spark, d):
    """The lists of the three algorithms side by side."""
    t = K.tfidf(docs(spark, d)).select("doc_id", F.lit("tfidf").alias("algorithm"), "rank", "term")
    t = t.unionAll(K.ngrams(docs(spark, d)).select("doc_id", F.lit("ngram").alias("algorithm"), "rank", "term"))
    return t.unionAll(K.textrank_top(docs(spark, d)).select("doc_id", F.lit("textrank").alias("algorithm"), "rank", "term"))


GRAM_PAGES = """pgr AS (SELECT doc_id, page, term AS g FROM seq UNION ALL SELECT doc_id, page, term || ' ' || b FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id, page ORDER BY n) AS b FROM seq) WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, page, term || ' ' || b || ' ' || c FROM (SELECT *, lead(term) OVER w AS b, lead(term, 2) OVER w AS c FROM seq WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)) WHERE c IS NOT NULL)"""


@query("kw_ngram_pages", f"WITH {NGRAM}, {RANKED}, {GRAM_PAGES} SELECT t.doc_id, t.g AS term, coalesce(string_agg(DISTINCT p.page, ',' ORDER BY p.page), '') AS pages FROM gt t LEFT JOIN pgr p ON p.doc_id = t.doc_id AND p.g = t.g GROUP BY t.doc_id, t.g")
def kw_ngram_pages(spark, d):
    found = K.ngram_pages(K.ngrams(docs(spark, d)), docs(spark, d))
    return found.select("doc_id", "term", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("kw_ngram_contexts", rf"""WITH {NGRAM}, {RANKED}
SELECT t.doc_id, g AS term, CAST(row_number() OVER w AS INT) AS k, page, item_index, left(text, 120) AS snippet FROM (SELECT doc_id, g FROM gt) t JOIN items i ON i.doc_id = t.doc_id AND contains(lower(text), string_split(g, ' ')[1]) AND regexp_matches(text, '(?is)' || array_to_string(string_split(g, ' '), '[\s\S]{{0,30}}')) WINDOW w AS (PARTITION BY t.doc_id, g ORDER BY page, item_index) QUALIFY k <= 3""")  # fmt: skip
def kw_ngram_contexts(spark, d):
    return K.ngram_contexts(K.ngrams(docs(spark, d)), docs(spark, d))


def _rows_sql(name: str, of: str, term: str, score: str, frequency: str, tag: str, pages: str, found: str) -> str:
    """Rows of one list with everything that belongs to a keyword."""
    return f"""SELECT t.doc_id, '{name}' AS algorithm, t.rank, t.{term} AS term, {score} AS score, t.{frequency} AS frequency, round(t.{frequency} / tot.n_tokens * 100, 6) AS percent,
  {COLOR.replace("rank", "t.rank")} AS color, {tag} AS tag, coalesce({pages}, '') AS pages,
  coalesce((SELECT string_agg(c.page || ':' || c.item_index || ':' || c.snippet, '|' ORDER BY c.nth) FROM {found} c WHERE c.doc_id = t.doc_id AND c.term = t.{term}), '') AS contexts
  FROM {of} t JOIN tot USING (doc_id)"""


_WORD_PAGES = "(SELECT string_agg(page, ',' ORDER BY page) FROM (SELECT DISTINCT page FROM seq s WHERE s.doc_id = t.doc_id AND s.term = t.term))"
_UNIT_TAG = f"CASE WHEN t.term IN ({_in(V.UNITS)}) THEN 'unit' END"
_WORDS = "words AS (SELECT doc_id, term FROM top UNION SELECT doc_id, term FROM gr20)"
_WORD_FOUND = r"""wf AS (SELECT t.doc_id, t.term, row_number() OVER w AS nth, i.page, i.item_index, left(i.text, 120) AS snippet FROM words t JOIN items i ON i.doc_id = t.doc_id
  AND CASE WHEN regexp_full_match(term, '[A-Za-z0-9_]+') THEN regexp_matches(text, '(?i)\b' || term || '\b') ELSE contains(lower(text), term) END WINDOW w AS (PARTITION BY t.doc_id, t.term ORDER BY i.page, i.item_index) QUALIFY nth <= 3)"""
_GRAM_FOUND = r"""gf AS (SELECT t.doc_id, g AS term, row_number() OVER w AS nth, page, item_index, left(text, 120) AS snippet FROM gt t JOIN items i ON i.doc_id = t.doc_id AND contains(lower(text), string_split(g, ' ')[1])
  AND regexp_matches(text, '(?is)' || array_to_string(string_split(g, ' '), '[\s\S]{0,30}')) WINDOW w AS (PARTITION BY t.doc_id, g ORDER BY page, item_index) QUALIFY nth <= 3)"""


@query("kw_rows", f"""WITH RECURSIVE {TOP_GRAPH}, {NGRAM[len(BASE) + 1:].strip()}, {RANKED}, {TFIDF[len(BASE) + 1:].strip()}, {_WORDS}, {_WORD_FOUND}, {_GRAM_FOUND}, {GRAM_PAGES},
gp AS (SELECT doc_id, g, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM pgr GROUP BY doc_id, g)
{_rows_sql("tfidf", "top", "term", "round(t.raw / best, 6)", "tf", _UNIT_TAG, _WORD_PAGES, "wf")} UNION ALL
{_rows_sql("textrank", "gr20", "term", "round(t.raw / best, 6)", "tf", _UNIT_TAG, _WORD_PAGES, "wf")} UNION ALL
{_rows_sql("ngram", "gt", "g", "round(CAST(t.raw AS DOUBLE) / best, 6)", "frequency", "[NULL, 'bigram', 'trigram'][t.k]", "(SELECT pages FROM gp WHERE gp.doc_id = t.doc_id AND gp.g = t.g)", "gf")}""")  # fmt: skip
def kw_rows(spark, d):
    """Every column of the keywords of all three algorithms, from stored pages."""
    rows = K.keywords(stored(ship(spark).read.parquet(f"{d}/documents.parquet")))
    part = F.transform("contexts", lambda c: F.concat(c["page"].cast("string"), F.lit(":"), c["item_index"].cast("string"), F.lit(":"), c["snippet"]))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return rows.withColumn("pages", F.coalesce(pages, F.lit(""))).withColumn("contexts", F.coalesce(F.array_join(part, "|"), F.lit("")))
