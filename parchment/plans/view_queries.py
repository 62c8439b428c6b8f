"""Queries of what a reader sees of matches and keywords: marks, places in snippets, the list and its window."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import fold as folding, nearest as N
from parchment.operators import highlights, keywords as K, result_list as R
from parchment.plans import sql
from parchment.plans.keyword_queries import NGRAM, RANKED, TFIDF, BASE
from parchment.plans.registry import query
from parchment.plans.search_queries import ORDER, _terms_sql, terms
from parchment.session import ship
from parchment.sources.tables import items, table
from parchment.sources.token_store import stored

_ACTIVE = f"""{TFIDF}, {NGRAM[len(BASE) + 1:].strip()}, {RANKED},
active AS (SELECT doc_id, term FROM top WHERE rank <= 5 UNION SELECT doc_id, g FROM gt WHERE rank <= 5)"""


@query("keyword_spans", rf"""WITH {_ACTIVE},
it AS (SELECT doc_id, page, item_index, text, regexp_extract_all(text, '{sql.RE}') AS ts, regexp_split_to_array(text, '{sql.RE}') AS gs FROM items),
iu AS (SELECT doc_id, page, item_index, unnest(range(len(ts))) AS pos, unnest(ts) AS token, unnest(gs[1:len(ts)]) AS gap FROM it WHERE len(ts) > 0),
ip AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id, page, item_index ORDER BY pos) AS e FROM iu),
ph AS (SELECT doc_id, page, item_index, term, regexp_split_to_array(text, '(?i)\b' || term || '\b') AS ps FROM items JOIN active USING (doc_id) WHERE contains(term, ' ') AND contains(lower(text), term)),
pu AS (SELECT doc_id, page, item_index, term, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) AS BIGINT) + (k - 1) * length(term) AS s FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM ph))
SELECT doc_id, page, item_index, CAST(e - length(token) AS INT) AS "start", CAST(e AS INT) AS "end", term FROM ip JOIN active USING (doc_id) WHERE lower(token) = term AND NOT contains(term, ' ')
UNION ALL SELECT doc_id, page, item_index, CAST(s AS INT), CAST(s + length(term) AS INT), term FROM pu""")  # fmt: skip
def keyword_spans(spark, d):
    """The places of each document's five best words and five best n-grams, from stored pages."""
    docs = stored(ship(spark).read.parquet(f"{d}/documents.parquet"))
    return highlights.keyword_spans(docs, K.best_terms(docs, 5))


def _after(tail: str) -> str:
    """The terms' CTEs, more of them, and a query."""
    return _terms_sql("@@").replace(") @@", ")" + tail)


#: (variant, shift of the place, whether the token is one that isn't there): right, near by, past the end, only a place, nothing.
VARIANTS = [(0, 0, False), (1, 3, False), (2, 100_000, False), (3, 0, True), (4, 100_000, True), (5, -2, False)]
_VAR = "(VALUES " + ", ".join(f"({v}, {s}, {str(z).lower()})" for v, s, z in VARIANTS) + ") v(variant, shift, odd)"
_IN = "({0} >= 0 AND {1} <= length(context) AND {0} < {1})"


@query("match_in_context", _after(rf""", q AS (SELECT doc_id, id, label, variant, context, CASE WHEN odd THEN '#no#' ELSE matched END AS token, char_start + shift AS s, char_end + shift AS e FROM found, {_VAR}),
p AS (SELECT *, {_IN.format("s", "e")} AS inside, CASE WHEN contains(lower(context), lower(token)) THEN list_filter(range(0, length(context) - length(token) + 1), lambda i: substr(lower(context), i + 1, length(token)) = lower(token)) ELSE [] END AS ps FROM q),
b AS (SELECT *, list_sort(list_transform(ps, lambda i: {{'d': abs(i - s), 'i': i}}))[1].i AS near FROM p)
SELECT doc_id, id, label, variant, CAST(CASE WHEN inside AND substr(lower(context), s + 1, e - s) = lower(token) THEN s WHEN near IS NOT NULL THEN near WHEN inside THEN s END AS INT) AS "start",
  CAST(CASE WHEN inside AND substr(lower(context), s + 1, e - s) = lower(token) THEN e WHEN near IS NOT NULL THEN near + length(token) WHEN inside THEN e END AS INT) AS "end" FROM b"""))  # fmt: skip
def match_in_context(spark, d):
    """Each match looked for in its context, with its own place and with wrong ones."""
    v = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(s).alias("shift"), F.lit(z).alias("odd")) for n, s, z in VARIANTS))).alias("v")
    q = terms(spark, d).select("doc_id", "id", "label", "context", "matched", "char_start", "char_end", v)
    token = F.when(F.col("v.odd"), "#no#").otherwise(F.col("matched"))
    place = N.match_in_context(F.col("context"), token, F.col("char_start") + F.col("v.shift"), F.col("char_end") + F.col("v.shift"))
    return q.select("doc_id", "id", "label", "v.variant", place.alias("p")).select("doc_id", "id", "label", "variant", "p.start", "p.end")


TOKENS = ["of the", "ofthe", "THE", "zz yy", ""]
_TOK = "(VALUES " + ", ".join(f"('{t}')" for t in TOKENS) + ") t(token)"


@query("token_in_span", rf"""WITH {sql.ITEMS}, q AS (SELECT doc_id, page, item_index, text, token, h AS hint FROM items, {_TOK}, (SELECT unnest([4, 1000000]) AS h)),
p AS (SELECT *, CASE WHEN token <> '' AND contains(lower(text), lower(token)) THEN list_filter(range(0, length(text) - length(token) + 1), lambda i: substr(lower(text), i + 1, length(token)) = lower(token)) ELSE [] END AS ps,
  regexp_replace(lower(token), '\s', '', 'g') AS bare, strpos(regexp_replace(lower(text), '\s', '', 'g'), regexp_replace(lower(token), '\s', '', 'g')) AS pl FROM q),
b AS (SELECT *, list_sort(list_transform(ps, lambda i: {{'d': abs(i - hint), 'i': i}}))[1].i AS near, CASE WHEN len(ps) = 0 AND bare <> '' AND pl > 0 THEN list_filter(range(0, length(text)), lambda i: NOT regexp_matches(substr(text, i + 1, 1), '\s')) END AS m FROM p)
SELECT doc_id, page, item_index, token, CAST(hint AS INT) AS hint, CAST(CASE WHEN near IS NOT NULL THEN near WHEN m IS NOT NULL THEN m[pl] WHEN hint + length(token) <= length(text) THEN hint END AS INT) AS "start",
  CAST(CASE WHEN near IS NOT NULL THEN near + length(token) WHEN m IS NOT NULL THEN m[pl + length(bare) - 1] + 1 WHEN hint + length(token) <= length(text) THEN hint + length(token) END AS INT) AS "end" FROM b""")  # fmt: skip
def token_in_span(spark, d):
    """Tokens looked for in every item: as they are, without white space, or by a hint that may be out of bounds."""
    it = items(table(spark, d, "documents")).select("doc_id", "page", "item_index", "text", F.explode(F.array(*map(F.lit, TOKENS))).alias("token"))
    it = it.select("*", F.explode(F.array(F.lit(4), F.lit(1_000_000))).alias("hint"))
    p = N.token_in_span(F.col("text"), F.col("token"), F.col("hint")).alias("p")
    return it.select("doc_id", "page", "item_index", "token", "hint", p).select("doc_id", "page", "item_index", "token", "hint", "p.start", "p.end")


_LIST = f""", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) - 1 AS gi FROM found),
g AS (SELECT doc_id, page, count(*) AS n, min(gi) AS first FROM o GROUP BY doc_id, page),
x AS (SELECT doc_id, page, first, first AS gi, 'header' AS kind, n, NULL AS global_index, NULL AS id, NULL AS label, 28 AS height FROM g UNION ALL
  SELECT o.doc_id, o.page, first, gi, 'result', NULL, gi, id, label, 56 FROM o JOIN g ON g.doc_id = o.doc_id AND g.page = o.page),
list AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS row_no, kind, page, n, global_index, id, label, CAST(sum(height) OVER w - height AS BIGINT) AS top, height FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY first, gi, kind))"""


@query("result_rows", _after(_LIST + " SELECT * FROM list"))
def result_rows(spark, d):
    """Each document's list: page headers and matches with global index and height above."""
    return R.list_rows(terms(spark, d))


@query("result_view", _after(_LIST + """,
f AS (SELECT doc_id, count(*) AS size, greatest(0, coalesce(min(row_no) FILTER (top + height > 400), 0) - 10) AS a FROM list GROUP BY doc_id),
t AS (SELECT f.doc_id, a, least(size, coalesce(min(row_no) FILTER (row_no >= a AND top > 900), size) + 10) AS b FROM f JOIN list USING (doc_id) GROUP BY f.doc_id, a, size)
SELECT list.* FROM list JOIN t USING (doc_id) WHERE row_no >= a AND row_no < b"""))
def result_view(spark, d):
    """What a view of 500 shows of each list that is scrolled by 400, with ten more rows on either side."""
    return R.visible(R.list_rows(terms(spark, d)), 400, 500)


@query("kept_index", _after(""", b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'same' END AS terms, count(*) AS n, count(*) - 1 + doc_id % 2 AS cur FROM found WHERE page <= 2 GROUP BY doc_id),
a AS (SELECT d.doc_id, count(id) AS n FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id AND f.label <> 'thing' GROUP BY d.doc_id)
SELECT a.doc_id, coalesce(b.n > 0 AND b.terms = 'same', false) AS again, CASE WHEN coalesce(b.n > 0 AND b.terms = 'same', false) AND cur >= 0 AND cur < a.n THEN cur WHEN a.n > 0 THEN 0 ELSE -1 END AS "at" FROM a LEFT JOIN b USING (doc_id)"""))
def kept_index(spark, d):
    """The place in each document's results: those of its first two pages against later ones of fewer terms, some searched for anew."""
    m, docs = terms(spark, d), table(spark, d, "documents").select("doc_id")
    before = m.filter("page <= 2").groupBy("doc_id").agg(F.count("*").alias("n"))
    before = before.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "other").otherwise("same").alias("terms"), "n", (F.col("n") - 1 + F.col("doc_id") % 2).alias("at"))
    after = docs.join(m.filter("label <> 'thing'").groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return R.kept_index(before, after.select("doc_id", F.lit("same").alias("terms"), F.coalesce("n", F.lit(0)).alias("n")))


@query("go_to_result", _after(f""", o AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) - 1 AS gi FROM found),
c AS (SELECT d.doc_id, coalesce(s.n, 0) AS n, CASE WHEN s.n > 0 THEN 0 ELSE -1 END AS cur, d.doc_id % 7 - 1 AS wanted FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) s ON s.doc_id = d.doc_id),
w AS (SELECT doc_id, CASE WHEN wanted >= 0 AND wanted < n THEN wanted ELSE cur END AS now FROM c)
SELECT w.doc_id, CAST(w.now AS BIGINT) AS "at", o.page FROM w LEFT JOIN o ON o.doc_id = w.doc_id AND o.gi = w.now"""))
def go_to_result(spark, d):
    """Jumps in each document's results, some to numbers that aren't there."""
    m, docs = terms(spark, d), table(spark, d, "documents").select("doc_id")
    sizes = m.groupBy("doc_id").agg(F.count("*").alias("n"))
    now = docs.join(sizes, "doc_id", "left").select("doc_id", F.when(F.col("n") > 0, 0).otherwise(-1).cast("bigint").alias("at"), (F.col("doc_id") % 7 - 1).alias("wanted"))
    return R.go_to(m, now)


#: Letters replaced, so that the documents hold a syllable of two letters, one of three, a ligature and a fraction.
_GREW = ("thea", "가각ﬁ½")
_GROWN = {c: folding.fold_char(c) for c in _GREW[1]}
_EACH = "CASE c " + " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in _GROWN.items()) + f" ELSE {sql.FOLD.format('c')} END"


@query("fold_offsets", f"""WITH {sql.ITEMS}, t AS (SELECT doc_id, page, item_index, translate(text, '{_GREW[0]}', '{_GREW[1]}') AS text FROM items),
f AS (SELECT doc_id, page, item_index, text, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: {_EACH}) AS ps FROM t),
g AS (SELECT *, array_to_string(ps, '') AS folded, flatten(list_transform(range(1, len(ps) + 1), lambda i: list_transform(range(length(ps[i])), lambda k: i - 1))) AS places FROM f),
h AS (SELECT *, strpos(folded, 'fi') AS pl FROM g)
SELECT doc_id, page, item_index, folded, array_to_string(places, ',') AS "at", CAST(CASE WHEN pl > 0 THEN places[pl] END AS INT) AS "start", CAST(CASE WHEN pl > 0 THEN places[pl + 1] + 1 END AS INT) AS "end" FROM h""")  # fmt: skip
def fold_offsets(spark, d):
    """Items with characters that grow when they are folded: the folded text, the way back, and the first ``fi`` found in it, led back."""
    it = items(table(spark, d, "documents")).select("doc_id", "page", "item_index", F.translate("text", *_GREW).alias("text"))
    m = it.select("doc_id", "page", "item_index", folding.fold_map(F.col("text")).alias("m")).withColumn("pl", F.instr(F.col("m.folded"), "fi") - 1)
    back = F.when(F.col("pl") >= 0, folding.original_span(F.col("m.at"), F.col("pl"), F.col("pl") + 2)).alias("s")
    rows = m.select("doc_id", "page", "item_index", "m.folded", F.concat_ws(",", F.col("m.at").cast("array<string>")).alias("at"), back)
    return rows.select("doc_id", "page", "item_index", "folded", "at", "s.start", "s.end")
