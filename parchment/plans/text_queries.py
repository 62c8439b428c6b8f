"""Queries of the text model: items, offsets, tokens and the functions on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import fold as folding
from parchment.functions import text as T
from parchment.operators import search as S
from parchment.plans import sql
from parchment.plans.registry import query
from parchment.sources.tables import all_pages, items, pages, table


def docs(spark, d):
    return table(spark, d, "documents")


@query("items_extract", f"WITH {sql.ITEMS} SELECT doc_id, page, item_index, text FROM items")
def items_extract(spark, d):
    return items(docs(spark, d)).select("doc_id", "page", "item_index", "text")


@query("doc_no_text", f"WITH {sql.ITEMS} SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM items) AS no_text FROM documents")
def doc_no_text(spark, d):
    some = F.exists(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: ~t.rlike(f"^{T.BLANK}*$"))
    return docs(spark, d).select("doc_id", (~some).alias("no_text"))


@query("token_offsets", f'WITH {sql.TOKENS} SELECT doc_id, page, pos, token, "start", "end" FROM tokens')
def token_offsets(spark, d):
    t = S.with_tokens(pages(docs(spark, d))).select("doc_id", "page", F.posexplode("toks").alias("pos", "t"))
    return t.select("doc_id", "page", "pos", "t.token", "t.start", "t.end")


@query("token_count", f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{sql.RE}')) AS n_tokens, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{sql.RE}'), lambda t: lower(t)))) AS n_distinct FROM documents")
def token_count(spark, d):
    ts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.TOKEN), F.lit(0))
    return docs(spark, d).withColumn("ts", ts).select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.array_distinct(F.transform("ts", F.lower))).cast("bigint").alias("n_distinct"))


@query("item_offsets", f'WITH {sql.ITEMS} SELECT doc_id, page, item_index, "start", "end" FROM offs')
def item_offsets(spark, d):
    return items(docs(spark, d)).select("doc_id", "page", "item_index", "start", "end")


@query("page_data", f"WITH {sql.TOKENS} SELECT pg.doc_id, pg.page, concat, (SELECT count(*) FROM tokens t WHERE t.doc_id = pg.doc_id AND t.page = pg.page) AS n_tokens, (SELECT count(*) FROM items i WHERE i.doc_id = pg.doc_id AND i.page = pg.page) AS n_items FROM pg")
def page_data(spark, d):
    pg = S.with_tokens(pages(docs(spark, d)))
    return pg.select("doc_id", "page", "concat", F.size("toks").cast("bigint").alias("n_tokens"), F.size("items").cast("bigint").alias("n_items"))


_PLACES = "CAST(floor(length(concat) * f / 4) AS INT)"


@query("locate_item", f"""WITH {sql.PAGES}, q AS (SELECT doc_id, page, {_PLACES} AS place FROM pg, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS f))
SELECT q.doc_id, q.page, place, coalesce((SELECT arg_min(item_index, "start") FROM offs o WHERE o.doc_id = q.doc_id AND o.page = q.page AND o."end" > place), (SELECT max(item_index) FROM offs o WHERE o.doc_id = q.doc_id AND o.page = q.page)) AS item_index FROM q""")  # fmt: skip
def locate_item(spark, d):
    pg = pages(docs(spark, d)).withColumn("f", F.explode(F.array(*map(F.lit, range(6)))))
    pg = pg.withColumn("place", F.floor(F.length("concat") * F.col("f") / 4).cast("int"))
    return pg.select("doc_id", "page", "place", T.item_at(F.col("items"), F.col("place"))["item_index"].alias("item_index"))


@query("match_spans", f"""WITH {sql.PAGES}, q AS (SELECT doc_id, page, CAST(length(concat) // 4 AS INT) AS s, CAST(length(concat) // 4 * 3 AS INT) AS e FROM pg),
o AS (SELECT q.doc_id, q.page, o.item_index, greatest(s - o."start", 0) AS a, least(length(o.text), e - o."start") AS b FROM q JOIN offs o ON o.doc_id = q.doc_id AND o.page = q.page AND o."end" > s AND o."start" < e)
SELECT doc_id, page, string_agg(item_index || ':' || a || '-' || b, ',' ORDER BY item_index) AS spans FROM o GROUP BY ALL HAVING count(*) > 1""")  # fmt: skip
def match_spans(spark, d):
    pg = pages(docs(spark, d)).withColumn("n", F.floor(F.length("concat") / 4).cast("int"))
    found = pg.select("doc_id", "page", T.spans(F.col("items"), F.col("n"), F.col("n") * 3).alias("sp")).filter("sp is not null")
    return found.select("doc_id", "page", F.array_join(F.transform("sp", lambda x: F.concat(x["item_index"].cast("string"), F.lit(":"), x["char_start"].cast("string"), F.lit("-"), x["char_end"].cast("string"))), ",").alias("spans"))


@query("strip_map", r"""WITH c AS (SELECT doc_id, text, string_split(text, '') AS cs FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS stripped,
array_to_string(list_filter(range(0, length(text)), lambda i: regexp_matches(cs[i + 1], '[\p{L}\p{N}]')), ',') AS places FROM c""")  # fmt: skip
def strip_map(spark, d):
    t = docs(spark, d).filter("text is not null").select("doc_id", F.col("text").alias("t"))
    return t.select("doc_id", T.stripped(F.col("t")).alias("stripped"), F.array_join(F.transform(T.stripped_map(F.col("t")), lambda i: i.cast("string")), ",").alias("places"))


@query("fold_tokens", f"WITH {sql.TOKENS} SELECT token, {sql.FOLD.format('token')} AS folded, count(*) AS n FROM tokens GROUP BY ALL")
def fold_tokens(spark, d):
    ts = S.with_tokens(pages(docs(spark, d))).select(F.explode("toks").alias("t")).groupBy(F.col("t.token").alias("token")).agg(F.count("*").alias("n"))
    return ts.select("token", folding.fold(F.col("token")).alias("folded"), "n")


@query("stem_tokens", f"WITH {sql.TOKENS}, v AS (SELECT {sql.FOLD.format('token')} AS k, count(*) AS n FROM tokens GROUP BY ALL) SELECT k AS folded, {sql.stem('k')} AS stem, n FROM v")
def stem_tokens(spark, d):
    return fold_tokens(spark, d).groupBy("folded").agg(F.sum("n").alias("n")).select("folded", folding.stem(F.col("folded")).alias("stem"), "n")


@query("edit_distance", f"WITH {sql.TOKENS}, v AS (SELECT DISTINCT lower(token) AS token FROM tokens) SELECT token, least(levenshtein(token, 'thing'), 3) AS distance FROM v")
def edit_distance(spark, d):
    v = S.with_tokens(pages(docs(spark, d))).select(F.explode("toks").alias("t")).select(F.lower("t.token").alias("token")).distinct()
    n = F.levenshtein(F.col("token"), F.lit("thing"), 2)
    return v.select("token", F.when(n < 0, 3).otherwise(n).cast("bigint").alias("distance"))


#: Queries made from documents: as they begin, with CJK letters, with a sign, empty, blank before.
_ASKED = "CASE doc_id % 5 WHEN 0 THEN left(text, 12) WHEN 1 THEN translate(left(text, 12), 'ae', '가電') WHEN 2 THEN concat(left(text, 5), '+') WHEN 3 THEN '' ELSE concat('  ', left(text, 3)) END"


@query("classify_query", rf"""SELECT doc_id, CASE WHEN trim(q, ' ' || chr(10)) = '' THEN 'empty' WHEN regexp_matches(q, '[\x{{1100}}-\x{{11FF}}\x{{3000}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{F900}}-\x{{FAFF}}]') THEN 'cjk'
WHEN regexp_matches(q, '[+#(){{}}\[\]@$%^&*=<>~`|\\]') THEN 'special' ELSE 'tokens' END AS kind FROM (SELECT doc_id, coalesce({_ASKED}, '') AS q FROM documents)""")  # fmt: skip
def classify_query(spark, d):
    df = docs(spark, d).select("doc_id", F.coalesce(F.expr(_ASKED), F.lit("")).alias("q"))
    kind = F.when(T.strip(F.col("q")) == "", "empty").when(F.col("q").rlike(T.CJK), "cjk").when(F.col("q").rlike(T.SPECIAL), "special").otherwise("tokens")
    return df.select("doc_id", kind.alias("kind"))


KOREAN = ["안녕하세요", "hello 안녕", "hello there you 안녕", "", "   ", "ㄱㄴ ab", "논문 paper", "한 abcdefg"]


@query("is_korean", r"""SELECT text, length(regexp_replace(text, '\s', '', 'g')) > 0 AND length(regexp_replace(text, '[^\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]', '', 'g')) > 0.3 * length(regexp_replace(text, '\s', '', 'g')) AS korean
FROM (SELECT text FROM documents WHERE doc_id % 1 = 0 AND text IS NOT NULL UNION ALL VALUES """.replace("doc_id % 1 = 0 AND ", "") + ", ".join(f"('{t}')" for t in KOREAN) + ") v(text)")  # fmt: skip
def is_korean(spark, d):
    df = docs(spark, d).select("text").filter("text is not null").unionAll(spark.createDataFrame([(t,) for t in KOREAN], "text string"))
    own, n = F.length(F.regexp_replace("text", "[^가-힯ᄀ-ᇿ㄰-㆏]", "")), F.length(F.regexp_replace("text", T.BLANK, ""))
    return df.select("text", ((n > 0) & (own > n * 0.3)).alias("korean"))


@query("clean_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')) AS clean FROM documents""")
def clean_text(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), r"[ \t]*\n[ \t]*", " "), r"[ \t]{2,}", " ")
    return docs(spark, d).select("doc_id", T.strip(t).alias("clean"))


@query("nearest_match", f"""WITH {sql.ITEMS}, q AS (SELECT doc_id, page, item_index, text, CAST(length(text) // 2 AS INT) AS hint FROM items),
p AS (SELECT *, list_filter(range(0, length(text) - 1), lambda i: substr(lower(text), i + 1, 2) = 'th') AS ps FROM q)
SELECT doc_id, page, item_index, hint, CAST(CASE WHEN len(ps) = 0 THEN CASE WHEN hint < length(text) THEN hint END ELSE list_sort(list_transform(ps, lambda i: {{'d': abs(i - hint), 'i': i}}))[1].i END AS INT) AS place FROM p""")  # fmt: skip
def nearest_match(spark, d):
    q = items(docs(spark, d)).withColumn("hint", F.floor(F.length("text") / 2).cast("int"))
    ps = T.places(F.lower("text"), "th")
    best = F.array_min(F.transform(ps, lambda i: F.struct(F.abs(i - F.col("hint")).alias("d"), i.alias("i"))))["i"]
    return q.select("doc_id", "page", "item_index", "hint", F.coalesce(best, F.when(F.col("hint") < F.length("text"), F.col("hint"))).alias("place"))


@query("token_in_item", f"""WITH {sql.ITEMS}, p AS (SELECT doc_id, page, item_index, text, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 1) <> ' ') AS m, strpos(replace(lower(text), ' ', ''), 'ofthe') AS pl FROM items)
SELECT doc_id, page, item_index, CAST(m[pl] AS INT) AS "start", CAST(m[pl + 4] + 1 AS INT) AS "end" FROM p WHERE pl > 0""")  # fmt: skip
def token_in_item(spark, d):
    """First place of a token in an item whose white space is ignored, mapped back."""
    df = items(docs(spark, d)).filter(F.contains(F.regexp_replace(F.lower("text"), " ", ""), F.lit("ofthe")))
    m = T.char_places(F.col("text"), "^[^ ]$")
    df = df.withColumn("m", m).withColumn("at", F.instr(F.regexp_replace(F.lower("text"), " ", ""), "ofthe"))
    return df.select("doc_id", "page", "item_index", F.get("m", F.col("at") - 1).alias("start"), (F.get("m", F.col("at") + 3) + 1).alias("end"))


@query("kwic_snippet", f"""WITH {sql.ITEMS}, p AS (SELECT *, strpos(lower(text), 'tion') - 1 AS pl FROM items)
SELECT doc_id, page, item_index, CASE WHEN pl < 0 THEN left(text, 120) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END
ELSE CASE WHEN pl > 20 THEN '...' ELSE '' END || substr(text, greatest(pl - 20, 0) + 1, pl - greatest(pl - 20, 0)) || substr(text, pl + 1, 4) || substr(text, pl + 5, 60) || CASE WHEN pl + 4 + 60 < length(text) THEN '...' ELSE '' END END AS snippet FROM p""")  # fmt: skip
def kwic_snippet(spark, d):
    df = items(docs(spark, d)).withColumn("at", F.instr(F.lower("text"), "tion") - 1)
    at, n = F.col("at"), F.length("text")
    lo = F.greatest(at - 20, F.lit(0))
    cut = F.concat(F.when(at > 20, "...").otherwise(""), F.substring("text", lo + 1, at + 64 - lo), F.when(at + 64 < n, "...").otherwise(""))
    short = F.concat(F.left("text", F.lit(120)), F.when(n > 120, "...").otherwise(""))
    return df.select("doc_id", "page", "item_index", F.when(at < 0, short).otherwise(cut).alias("snippet"))


@query("snippet_parts", f"""WITH {sql.ITEMS} SELECT doc_id, page, item_index, len(regexp_extract_all(left(text, 120), '(?i)the')) AS n_marked, array_to_string(regexp_split_to_array(left(text, 120), '(?i)the'), '|') AS rest FROM items""")
def snippet_parts(spark, d):
    t = F.left("text", F.lit(120))
    return items(docs(spark, d)).select("doc_id", "page", "item_index", F.size(F.regexp_extract_all(t, F.lit("(?i)the"), F.lit(0))).cast("bigint").alias("n_marked"), F.array_join(F.split(t, "(?i)the", -1), "|").alias("rest"))


@query("line_kinds", r"""WITH l AS (SELECT conv_id, turn, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations UNION ALL VALUES (-1, -1, ['- item', '* item', '1. one', '# Head', '### Sub', '', 'text **bold** more', '12) no']))) SELECT conv_id, turn, CAST(i AS INT) AS line_no,
CASE WHEN trim(line) = '' THEN 'empty' WHEN regexp_matches(line, '^\s*[-*]\s+') THEN 'bullet' WHEN regexp_matches(line, '^\s*\d+\.\s+') THEN 'numbered' WHEN regexp_matches(line, '^#{1,3}\s+') THEN 'heading' ELSE 'text' END AS kind, len(regexp_extract_all(line, '\*\*[^*]+\*\*')) AS n_bold FROM l""")  # fmt: skip
def line_kinds(spark, d):
    extra = spark.createDataFrame([(-1, -1, "- item\n* item\n1. one\n# Head\n### Sub\n\ntext **bold** more\n12) no")], "conv_id bigint, turn bigint, text string")
    c = table(spark, d, "conversations").select("conv_id", "turn", "text").unionAll(extra)
    ls = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kind = F.when(F.trim("line") == "", "empty").when(F.col("line").rlike(r"^\s*[-*]\s+"), "bullet").when(F.col("line").rlike(r"^\s*\d+\.\s+"), "numbered").when(F.col("line").rlike(r"^#{1,3}\s+"), "heading").otherwise("text")
    return ls.select("conv_id", "turn", "line_no", kind.alias("kind"), F.size(F.regexp_extract_all("line", F.lit(r"\*\*[^*]+\*\*"), F.lit(0))).cast("bigint").alias("n_bold"))


@query("page_blank_counts", f"WITH {sql.ITEMS} SELECT doc_id, CAST(max(pos // 5 + 1) AS INT) AS n_pages, CAST(count(*) FILTER (trim(text) = '') AS BIGINT) AS n_blank FROM lines GROUP BY doc_id")
def page_blank_counts(spark, d):
    ap = all_pages(docs(spark, d)).groupBy("doc_id").agg(F.max("page").alias("n_pages"), F.sum(F.size("items")).alias("kept"))
    lines = docs(spark, d).select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    return ap.join(lines, "doc_id").select("doc_id", "n_pages", (F.col("n") - F.col("kept")).cast("bigint").alias("n_blank"))
