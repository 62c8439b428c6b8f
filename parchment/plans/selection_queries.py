"""Queries of selection expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.operators import selection as S
from parchment.plans import sql
from parchment.plans.registry import query
from parchment.sources.tables import items, pages, table

ANCHOR = "CAST(length(text) // 3 AS INT)"


@query("select_word", rf"""WITH {sql.ITEMS}, q AS (SELECT doc_id, page, item_index, text, {ANCHOR} AS at_ FROM items),
p AS (SELECT *, regexp_extract(substr(text, 1, at_), '[\p{{L}}\p{{N}}''-]*$') AS l, regexp_extract(substr(text, at_ + 1), '^[\p{{L}}\p{{N}}''-]*') AS r, regexp_extract(substr(text, at_ + 1), '^([^\p{{L}}\p{{N}}''-]*)([\p{{L}}\p{{N}}''-]+)', ['g', 'w']) AS f FROM q)
SELECT doc_id, page, item_index, CASE WHEN l <> '' OR r <> '' THEN substr(text, at_ + 1 - length(l), length(l) + length(r)) ELSE nullif(f.w, '') END AS word FROM p""")  # fmt: skip
def select_word(spark, d):
    it = items(table(spark, d, "documents"))
    at = F.floor(F.length("text") / 3).cast("int")
    s, e = S.word_at(F.col("text"), at)
    return it.select("doc_id", "page", "item_index", F.substring("text", s + 1, e - s).alias("word"))


_ENDS = """list_filter(range(0, length(concat)), lambda i: substr(concat, i + 1, 1) IN ('!', '?', '。', '！', '？') OR (substr(concat, i + 1, 1) = '.'
 AND NOT (i > 0 AND regexp_matches(substr(concat, i, 1), '[0-9]') AND regexp_matches(substr(concat, i + 2, 1), '[0-9]')) AND NOT (i > 0 AND regexp_matches(substr(concat, i, 1), '[A-Za-z]') AND regexp_matches(substr(concat, i + 2, 1), '[A-Za-z]'))))"""


@query("sentence_bounds", f"WITH {sql.PAGES}, p AS (SELECT doc_id, page, {_ENDS} AS ends FROM pg WHERE doc_id IS NOT NULL) SELECT doc_id, page, len(ends) AS n, coalesce(list_sum(ends), 0)::BIGINT AS places FROM p")
def sentence_bounds(spark, d):
    """Number and sum of the places of a page's sentence ends."""
    p = pages(table(spark, d, "documents")).select("doc_id", "page", S.sentence_ends(F.col("concat")).alias("ends"))
    return p.select("doc_id", "page", F.size("ends").cast("bigint").alias("n"), F.aggregate("ends", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("places"))


@query("select_sentence", rf"""WITH {sql.PAGES}, p AS (SELECT doc_id, page, concat, CAST(length(concat) // 2 AS INT) AS at_, {_ENDS} AS ends FROM pg),
b AS (SELECT *, coalesce(list_max(list_filter(ends, lambda e: e < at_)) + 1, 0) AS first, list_min(list_filter(ends, lambda e: e >= at_)) AS after FROM p),
c AS (SELECT *, first + length(regexp_extract(substr(concat, first + 1), '^["'')\]”’»]*\s*')) AS s, coalesce(after + 1 + length(regexp_extract(substr(concat, after + 2), '^["'')\]”’»]*')), length(concat)) AS e FROM b)
SELECT doc_id, page, CAST(least(s, e) AS INT) AS "start", CAST(e AS INT) AS "end" FROM c""")  # fmt: skip
def select_sentence(spark, d):
    p = pages(table(spark, d, "documents"))
    s, e = S.sentence_at(F.col("concat"), F.floor(F.length("concat") / 2).cast("int"))
    return p.select("doc_id", "page", s.alias("start"), e.alias("end"))


#: The lines of a document have no geometry: a line stands 14 units below the last one, 40 where a gap in the item numbers shows a blank.
_Y = "CAST(item_index * 14 + CASE WHEN length(text) % 7 = 0 THEN 26 ELSE 0 END AS DOUBLE)"


@query("select_paragraph", f"""WITH {sql.ITEMS}, y AS (SELECT doc_id, page, item_index, {_Y} AS y, item_index = min(item_index) OVER (PARTITION BY doc_id, page) AS anchor FROM items),
c AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 18 THEN 1 ELSE 0 END AS cut FROM y WINDOW w AS (PARTITION BY doc_id, page ORDER BY item_index)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY item_index) AS part FROM c) SELECT doc_id, page, item_index FROM g WHERE part = 0""")  # fmt: skip
def select_paragraph(spark, d):
    from pyspark.sql import Window

    y = (F.col("item_index") * 14 + F.when(F.length("text") % 7 == 0, 26).otherwise(0)).cast("double")
    it = items(table(spark, d, "documents")).select("doc_id", "page", "item_index", y.alias("y"), F.lit(0.0).alias("height"))
    it = it.withColumn("least", F.min("item_index").over(Window.partitionBy("doc_id", "page")))
    return S.paragraphs(it, F.col("item_index") == F.col("least")).select("doc_id", "page", "item_index")


LEVELS = ("word", "sentence", "paragraph")


@query("next_level", f"SELECT event_id, level, CASE WHEN level = 'word' THEN 'sentence' ELSE 'paragraph' END AS following FROM (SELECT event_id, {list(LEVELS)}[event_id % 3 + 1] AS level FROM events)")
def next_level(spark, d):
    """What a further click selects, from the level that each event stands at."""
    level = F.get(F.array(*map(F.lit, LEVELS)), (F.col("event_id") % 3).cast("int"))
    return table(spark, d, "events").select("event_id", level.alias("level"), S.next_level(level).alias("following"))
