"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from parchment.functions import fold as folding
from parchment.functions.fixed_values import PALETTE
from parchment.operators import result_list as R
from parchment.operators import search as S
from parchment.plans import sql
from parchment.plans.registry import query
from parchment.session import ship
from parchment.sources.tables import pages, table
from parchment.sources.token_store import stored

ROW = 'doc_id, page, item_index, "start", matched, context, char_start, char_end, n_spans'
CTE = sql.TOKENS + ", hits AS (@HITS@)," + sql.LOCATED
TERMS = [("of the", "#fde047", "of the"), ("onthe", "#86efac", "onthe"), ("thing", "#93c5fd", "thing")]


def docs(spark, d):
    return table(spark, d, "documents")


def tok(spark, d):
    return S.with_tokens(pages(docs(spark, d)))


def flat(df, *more):
    """FIELDS with the number of spanned items in place of the spans."""
    n = F.coalesce(F.size("spans"), F.lit(1)).cast("bigint")
    return df.withColumn("n_spans", n).select("doc_id", "page", "item_index", "start", "matched", "context", "char_start", "char_end", "n_spans", *more)


def plain(select: str, fix: str = "n_spans") -> str:
    return f"WITH {CTE.replace("@HITS@", select)} SELECT {ROW.replace('n_spans', fix + ' AS n_spans')} FROM located"


@query("search_exact", plain(sql.runs(["the"], "lower(token)", 0), "CAST(1 AS BIGINT)"))
def search_exact(spark, d):
    return flat(S.exact(tok(spark, d), "The"))


@query("search_phrase", plain(sql.runs(["of", "the"], "lower(token)", 0)))
def search_phrase(spark, d):
    return flat(S.exact(tok(spark, d), "of the"))


@query("search_special", plain("SELECT doc_id, page, p AS s, p + 1 AS e, 0 AS tier FROM (SELECT doc_id, page, unnest(list_filter(range(0, length(concat)), lambda i: substr(concat, i + 1, 1) = '@')) AS p FROM pg)"))
def search_special(spark, d):
    return flat(S.special(pages(docs(spark, d)), "@"))


@query("search_fallback", plain(sql.fallback("onthe")))
def search_fallback(spark, d):
    pg = tok(spark, d)
    return flat(S.fallback(pg, "onthe", S.exact(pg, "onthe")))


@query("search_folded", plain(sql.runs(["fur"], sql.FOLD.format("token"), 1)))
def search_folded(spark, d):
    return flat(S.match_runs(tok(spark, d), ["fur"], folding.fold))


@query("search_stemmed", plain(sql.runs(["thing"], sql.stem(sql.FOLD.format("token")), 2)))
def search_stemmed(spark, d):
    return flat(S.match_runs(tok(spark, d), ["thing"], lambda t: folding.stem(folding.fold(t))))


@query("search_fuzzy", plain(sql.fuzzy("thing"), "CAST(1 AS BIGINT)"))
def search_fuzzy(spark, d):
    return flat(S.fuzzy(pages(docs(spark, d)), "thing"))


#: Letters of the documents replaced by CJK ones.
CJK_LETTERS = ("thea", "인공지능")


def cjk_docs(spark, d):
    return docs(spark, d).select("doc_id", F.translate("text", *CJK_LETTERS).alias("text"))


_CJK_ITEMS = sql.ITEMS.replace("FROM documents", f"FROM (SELECT doc_id, translate(text, '{CJK_LETTERS[0]}', '{CJK_LETTERS[1]}') AS text FROM documents)")


def _cjk_sql(q: str) -> str:
    k = len(q)
    return rf"""WITH {_CJK_ITEMS},
o AS (SELECT *, row_number() OVER w - 1 AS k, CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, CAST(sum(length(text)) OVER w AS BIGINT) AS b FROM items WINDOW w AS (PARTITION BY doc_id, page ORDER BY item_index)),
p AS (SELECT doc_id, page, string_agg(text, '' ORDER BY item_index) AS concat, count(*) AS n FROM items GROUP BY ALL),
m AS (SELECT *, regexp_replace(concat, '[^\p{{L}}\p{{N}}]', '', 'g') AS st, list_filter(range(0, length(concat)), lambda i: regexp_matches(substr(concat, i + 1, 1), '[\p{{L}}\p{{N}}]')) AS map FROM p),
h AS (SELECT doc_id, page, concat, n, map[i] AS s, map[i + {k} - 1] + 1 AS e FROM (SELECT *, unnest(list_filter(range(1, length(st) - {k} + 2), lambda i: substr(st, i, {k}) = '{q}')) AS i FROM m)),
g AS (SELECT h.*, (SELECT min(k) FROM o WHERE o.doc_id = h.doc_id AND o.page = h.page AND b > s) AS lo, (SELECT max(k) FROM o WHERE o.doc_id = h.doc_id AND o.page = h.page AND a < e) AS hi FROM h),
grow AS (WITH RECURSIVE r AS (
  SELECT doc_id, page, s, e, n, lo, hi, CAST((SELECT sum(length(text)) FROM o WHERE o.doc_id = g.doc_id AND o.page = g.page AND k BETWEEN lo AND hi) AS BIGINT) AS c, 0 AS step FROM g
  UNION ALL
  SELECT doc_id, page, s, e, n, CASE WHEN step % 2 = 0 AND lo > 0 THEN lo - 1 ELSE lo END, CASE WHEN step % 2 = 1 AND hi < n - 1 THEN hi + 1 ELSE hi END,
    c + CASE WHEN step % 2 = 0 AND lo > 0 THEN (SELECT length(text) FROM o WHERE o.doc_id = r.doc_id AND o.page = r.page AND k = lo - 1) WHEN step % 2 = 1 AND hi < n - 1 THEN (SELECT length(text) FROM o WHERE o.doc_id = r.doc_id AND o.page = r.page AND k = hi + 1) ELSE 0 END, step + 1
  FROM r WHERE c < 80 AND (lo > 0 OR hi < n - 1))
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, page, s ORDER BY step DESC) = 1)
SELECT w.doc_id, w.page, (SELECT arg_min(item_index, a) FROM o WHERE o.doc_id = w.doc_id AND o.page = w.page AND b > s) AS item_index, CAST(s AS INT) AS "start", substr(p.concat, s + 1, e - s) AS matched,
  (SELECT string_agg(text, '' ORDER BY k) FROM o WHERE o.doc_id = w.doc_id AND o.page = w.page AND k BETWEEN lo AND hi) AS context,
  CAST(s - (SELECT a FROM o WHERE o.doc_id = w.doc_id AND o.page = w.page AND k = lo) AS INT) AS char_start, CAST(e - (SELECT a FROM o WHERE o.doc_id = w.doc_id AND o.page = w.page AND k = lo) AS INT) AS char_end,
  (SELECT count(*) FROM o WHERE o.doc_id = w.doc_id AND o.page = w.page AND b > s AND a < e) AS n_spans
FROM grow w JOIN p ON p.doc_id = w.doc_id AND p.page = w.page"""


@query("search_cjk", _cjk_sql("인공지능"))
def search_cjk(spark, d):
    """A word of CJK letters across spaces and line ends, over documents some of whose letters are such."""
    return flat(S.cjk(pages(cjk_docs(spark, d), ""), "인공 지능"))


@query("cjk_context", f"SELECT doc_id, page, \"start\", char_start, char_end, context FROM ({_cjk_sql('능지인')})")
def cjk_context(spark, d):
    """What is shown around a match: its items and more on either side in turn, up to eighty characters."""
    return S.cjk(pages(cjk_docs(spark, d), ""), "능지인").select("doc_id", "page", "start", "char_start", "char_end", "context")


@query("search_document", f"WITH {sql.TOKENS}, {sql.document('thing')} SELECT {ROW}, tier FROM found")
def search_document(spark, d):
    return flat(S.search_document(docs(spark, d), " Thing "), "tier")


def _terms_sql(tail: str) -> str:
    parts, names = [], []
    for n, (t, color, label) in enumerate(TERMS):
        parts.append(sql.document(t, name=f"f{n}"))
        names.append(f"SELECT *, {n} AS term_ord, '{color}' AS color, '{label}' AS label FROM f{n}")
    return f"""WITH {sql.TOKENS}, {", ".join(parts)}, every AS ({" UNION ALL ".join(names)}),
found AS (SELECT *, page || '-' || item_index || '-' || "start" AS id FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, page, item_index, "start", label ORDER BY term_ord, tier, char_start) = 1) {tail}"""


def terms(spark, d):
    return S.search_terms(docs(spark, d), TERMS)


@query("search_terms", _terms_sql(f"SELECT {ROW}, tier, color, label, id FROM found"))
def search_terms(spark, d):
    return flat(terms(spark, d), "tier", "color", "label", "id")


@query("search_stored", _terms_sql(f"SELECT {ROW}, tier, color, label, id FROM found"))
def search_stored(spark, d):
    """The same search over stored pages: nothing is tokenised again, documents are where their buckets are."""
    return flat(S.search_terms(stored(ship(spark).read.parquet(f"{d}/documents.parquet")), TERMS), "tier", "color", "label", "id")


@query("matches_on_page", _terms_sql("SELECT doc_id, id, label FROM found WHERE page = 2"))
def matches_on_page(spark, d):
    return terms(spark, d).filter("page = 2").select("doc_id", "id", "label")


@query("matches_by_page", _terms_sql(f""", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, item_index, term_ord, tier, char_start) - 1 AS gi FROM found),
g AS (SELECT doc_id, page, count(*) AS n, min(gi) AS first FROM o GROUP BY doc_id, page),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INT) AS header FROM g)
SELECT doc_id, header, page, header = 1 AS first_page, 'header' AS kind, n, NULL AS global_index, NULL AS id, NULL AS label FROM h
UNION ALL SELECT o.doc_id, header, o.page, header = 1, 'result', NULL, gi, id, label FROM o JOIN h ON h.doc_id = o.doc_id AND h.page = o.page"""))
def matches_by_page(spark, d):
    """The matches of each document grouped by page: a header with the page's number of matches, then these with their global index."""
    first = (F.col("header") == 1).alias("first_page")
    return R.by_page(terms(spark, d)).select("doc_id", "header", "page", first, "kind", "n", "global_index", "id", "label")


@query("term_stats", _terms_sql("SELECT t.label, count(f.id) AS n, count(DISTINCT (f.doc_id, f.page)) AS n_pages, least(count(f.id), 99) AS badge FROM (VALUES ('of the'), ('onthe'), ('thing'), ('zzzz')) t(label) LEFT JOIN found f ON f.label = t.label GROUP BY t.label").replace("count(DISTINCT (f.doc_id, f.page))", "count(DISTINCT f.doc_id || '-' || f.page)"))
def term_stats(spark, d):
    g = terms(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "page").alias("n_pages"))
    t = spark.createDataFrame([("of the",), ("onthe",), ("thing",), ("zzzz",)], "label string")
    j = t.join(g, "label", "left").fillna(0, ["n", "n_pages"])
    return j.select("label", "n", "n_pages", F.least("n", F.lit(99)).cast("bigint").alias("badge"))


ORDER = "page, item_index, term_ord, tier, char_start"


@query("result_window", _terms_sql(f"""SELECT doc_id, id, label, top FROM (SELECT *, CAST(sum(56 + CASE WHEN new THEN 28 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY {ORDER}) - 56 AS BIGINT) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY {ORDER}) = 1 AS new FROM found)) WHERE top BETWEEN 300 AND 900"""))
def result_window(spark, d):
    """Rows of a list whose page headers are 28 and rows 56 high that lie in a window of heights."""
    order = ["page", "item_index", "term_ord", "tier", "char_start"]
    w = Window.partitionBy("doc_id").orderBy(*order)
    new = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)) == 1
    t = terms(spark, d).withColumn("h", F.when(new, 84).otherwise(56))
    return t.withColumn("top", F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 56).filter(F.col("top").between(300, 900)).select("doc_id", "id", "label", "top")


@query("match_neighbours", _terms_sql(f"""SELECT doc_id, id, label, coalesce(lag(id) OVER w, last(id) OVER a) AS previous, coalesce(lead(id) OVER w, first(id) OVER a) AS following FROM found
WINDOW w AS (PARTITION BY doc_id ORDER BY {ORDER}), a AS (PARTITION BY doc_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""))
def match_neighbours(spark, d):
    w = Window.partitionBy("doc_id").orderBy("page", "item_index", "term_ord", "tier", "char_start")
    a = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return terms(spark, d).select("doc_id", "id", "label", F.coalesce(F.lag("id").over(w), F.last("id").over(a)).alias("previous"), F.coalesce(F.lead("id").over(w), F.first("id").over(a)).alias("following"))


@query("term_palette", f"""WITH a AS (SELECT conv_id, turn, unnest(range(len(ws))) AS i, unnest(ws) AS t FROM (SELECT conv_id, turn, string_split(left(text, 60), ' ') AS ws FROM conversations)),
u AS (SELECT conv_id, turn, i, trim(t, ' ' || chr(10)) AS term FROM a WHERE trim(t, ' ' || chr(10)) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(t, ' ' || chr(10))) ORDER BY turn, i) = 1)
SELECT conv_id, term, [{", ".join(f"'{c}'" for c in PALETTE)}][(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1) % 10 + 1] AS color FROM u""")  # fmt: skip
def term_palette(spark, d):
    """Each conversation's words added as terms one after another: trimmed, doubles refused, colors in turn."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.left("text", F.lit(60)), " ")).alias("i", "t"))
    return S.term_list(c.select("conv_id", F.struct("turn", "i").alias("at"), "t"), "conv_id")


@query("keyword_occurrences", rf"""WITH {sql.ITEMS}, w AS (SELECT doc_id, page, item_index, 'thing' AS keyword, len(list_filter(regexp_extract_all(lower(text), '{sql.RE}'), lambda t: t = 'thing')) AS n FROM items),
p AS (SELECT doc_id, page, item_index, 'of the' AS keyword, len(regexp_extract_all(text, '(?i)\bof the\b')) AS n FROM items) SELECT * FROM (SELECT * FROM w UNION ALL SELECT * FROM p) WHERE n > 0""")  # fmt: skip
def keyword_occurrences(spark, d):
    """Occurrences of active keywords in each item: single words as tokens, several as a phrase between ASCII word borders."""
    from parchment.functions.text import TOKEN
    from parchment.sources.tables import items

    it = items(docs(spark, d)).select("doc_id", "page", "item_index", "text")
    one = F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), lambda t: t == "thing"))
    many = F.size(F.regexp_extract_all("text", F.lit("(?i)(?<![A-Za-z0-9_])of the(?![A-Za-z0-9_])"), F.lit(0)))
    pairs = F.explode(F.array(F.struct(F.lit("thing").alias("keyword"), one.alias("n")), F.struct(F.lit("of the").alias("keyword"), many.alias("n")))).alias("x")
    return it.select("doc_id", "page", "item_index", pairs).select("doc_id", "page", "item_index", "x.keyword", F.col("x.n").cast("bigint").alias("n")).filter("n > 0")
