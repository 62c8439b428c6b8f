"""Queries of view state."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.operators import keywords as K
from parchment.operators import state as S
from parchment.plans import sql
from parchment.plans.keyword_queries import TFIDF
from parchment.plans.registry import query
from parchment.plans.service_queries import REQ, requests
from parchment.sources.tables import pages, table

@query("clamp_view", "SELECT event_id, greatest(1, least(1 + user_id % 9, event_id % 13 - 2)) AS page, greatest(0.5::DOUBLE, least(3.0::DOUBLE, value / 100)) AS scale FROM events")
def clamp_view(spark, d):
    """A page and a scale asked for by each event, some out of bounds."""
    e = table(spark, d, "events")
    return e.select("event_id", S.clamp(F.col("event_id") % 13 - 2, F.lit(1), 1 + F.col("user_id") % 9).alias("page"), S.clamp(F.col("value") / 100, F.lit(0.5), F.lit(3.0)).alias("scale"))


KEYS = ("ArrowRight", "ArrowLeft", "ArrowUp", "ArrowDown", "Home", "End", "Tab")


@query("tab_index", f"""SELECT event_id, CASE WHEN n <= 0 THEN -1 WHEN key IN ('ArrowRight', 'ArrowDown') THEN (c + 1) % n WHEN key IN ('ArrowLeft', 'ArrowUp') THEN (c - 1 + n) % n WHEN key = 'Home' THEN 0 WHEN key = 'End' THEN n - 1 ELSE -1 END AS to_tab
FROM (SELECT event_id, {list(KEYS)}[event_id % 7 + 1] AS key, event_id % 4 AS n, CASE WHEN event_id % 4 > 0 THEN user_id % (event_id % 4) ELSE 0 END AS c FROM events)""")
def tab_index(spark, d):
    """Where each of the events, taken as key strokes in some tabs, moves to."""
    n = F.col("event_id") % 4
    key = F.get(F.array(*map(F.lit, KEYS)), (F.col("event_id") % 7).cast("int"))
    e = table(spark, d, "events").select("event_id", key.alias("key"), n.alias("n"), F.when(n > 0, F.expr("try_mod(user_id, event_id % 4)")).otherwise(0).alias("c"))
    e = e.withColumn("some", F.greatest("n", F.lit(1)))  # division by no tabs isn't asked
    return e.select("event_id", F.when(F.col("n") > 0, F.coalesce(S.tab_index(F.col("key"), F.col("c"), F.col("some")), F.lit(-1))).otherwise(-1).alias("to_tab"))


@query("visible_pages", f"WITH {sql.PAGES}, n AS (SELECT doc_id, max(page) AS n_pages FROM pg GROUP BY doc_id) SELECT pg.doc_id, pg.page, array_to_string(range(greatest(pg.page - 2, 1), least(pg.page + 2, n_pages) + 1), ',') AS drawn FROM pg JOIN n ON n.doc_id = pg.doc_id")
def visible_pages(spark, d):
    p = pages(table(spark, d, "documents")).select("doc_id", "page")
    n = p.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    seen = S.visible_pages(F.col("page"), F.col("n_pages"))
    return p.join(n, "doc_id").select("doc_id", "page", F.array_join(F.transform(seen, lambda x: x.cast("string")), ",").alias("drawn"))


@query("page_chips", f"WITH {TFIDF}, p AS (SELECT t.doc_id, t.term, list_sort(list(DISTINCT s.page)) AS ps FROM top t JOIN seq s ON s.doc_id = t.doc_id AND s.term = t.term GROUP BY t.doc_id, t.term) SELECT doc_id, term, array_to_string(ps[1:5], ',') AS chips, greatest(len(ps) - 5, 0) AS more FROM p")
def page_chips(spark, d):
    """The first five pages of a keyword and the number of the others."""
    docs = table(spark, d, "documents")
    t = K.with_pages(K.tfidf(docs), docs)
    return t.select("doc_id", "term", F.array_join(F.transform(F.slice("pages", 1, 5), lambda p: p.cast("string")), ",").alias("chips"), F.greatest(F.size("pages") - 5, F.lit(0)).cast("bigint").alias("more"))


@query("retry_gate", f"""WITH RECURSIVE {REQ}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ms, id) AS k FROM req),
r AS (SELECT client, id, k, ms + 60000 AS retry_at FROM o WHERE k = 1 UNION ALL SELECT o.client, o.id, o.k, CASE WHEN o.ms >= r.retry_at THEN o.ms + 60000 ELSE r.retry_at END FROM r JOIN o ON o.client = r.client AND o.k = r.k + 1) SELECT client, id, retry_at FROM r""")  # fmt: skip
def retry_gate(spark, d):
    return S.retry_gate(requests(spark, d), "client")


CODES = [*S.MESSAGES, "OTHER"]


@query("error_message", "SELECT event_id, CASE WHEN code = 'RATE_LIMITED' AND t <> '' THEN t WHEN code = 'SERVER_ERROR' AND t <> '' THEN '서버 오류 (' || t || ')' WHEN code = 'API_ERROR' AND t <> '' THEN '오류: ' || t ELSE coalesce(m.text, '" + S.UNKNOWN + f"') END AS message FROM (SELECT event_id, {CODES}[event_id % {len(CODES)} + 1] AS code, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS t FROM events) LEFT JOIN (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in S.MESSAGES.items()) + ") m(c, text) ON m.c = code")
def error_message(spark, d):
    """What a reader is told if each event were an error with a code, with or without details."""
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("event_id") % len(CODES)).cast("int"))
    detail = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", S.error_message(code, detail).alias("message"))


#: Saved states as they may be found, made from events: right, of wrong types, of unknown values, none, and no JSON.
_STATE = """CASE WHEN event_id % 17 = 0 THEN 'no json' WHEN event_id % 19 = 0 THEN 'null' ELSE concat('{"hasSeenTutorial": ', CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"yes"' END,
  ', "viewerMode": ', CASE event_id % 4 WHEN 0 THEN '"page"' WHEN 1 THEN '"scroll"' WHEN 2 THEN '"book"' ELSE '3' END, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ', "sidebarTab": "chat"' WHEN 2 THEN ', "sidebarTab": "keywords"' ELSE ', "sidebarTab": "x"' END,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ', "dailyUsage": {"translate": 4, "chat": "5", "date": "d"}' WHEN 2 THEN ', "dailyUsage": 7' ELSE concat(', "dailyUsage": {"translate": ', CAST(user_id AS {string}), ', "chat": 2.5, "date": "2026-01-0', CAST(event_id % 9 AS {string}), '"}') END, '}') END"""
_NUMBER = "json_type(s, '$.dailyUsage.{0}') IN ('DOUBLE', 'UBIGINT', 'BIGINT')"
_USED = f"json_valid(s) AND coalesce({_NUMBER.format('translate')} AND {_NUMBER.format('chat')} AND json_type(s, '$.dailyUsage.date') = 'VARCHAR', false)"


@query("migrate_state", f"""SELECT event_id, CASE WHEN json_valid(s) AND json_type(s, '$.hasSeenTutorial') = 'BOOLEAN' THEN CAST(json_extract(s, '$.hasSeenTutorial') AS BOOLEAN) ELSE false END AS seen,
  CASE WHEN {_USED} THEN CAST(json_extract(s, '$.dailyUsage.translate') AS DOUBLE) ELSE 0 END AS translate, CASE WHEN {_USED} THEN CAST(json_extract(s, '$.dailyUsage.chat') AS DOUBLE) ELSE 0 END AS chat, CASE WHEN {_USED} THEN json_extract_string(s, '$.dailyUsage.date') ELSE '' END AS day,
  CASE WHEN json_valid(s) AND json_extract_string(s, '$.viewerMode') IN ('scroll', 'page') THEN json_extract_string(s, '$.viewerMode') ELSE 'scroll' END AS mode, CASE WHEN json_valid(s) AND json_extract_string(s, '$.sidebarTab') IN ('search', 'keywords', 'chat') THEN json_extract_string(s, '$.sidebarTab') ELSE 'search' END AS tab
FROM (SELECT event_id, CASE WHEN json_valid(s) THEN s ELSE '{{}}' END AS s FROM (SELECT event_id, {_STATE.replace("{string}", "VARCHAR")} AS s FROM events))""")  # fmt: skip
def migrate_state(spark, d):
    """Every field of a saved state: what has its type and a known value stays, anything else gets its default."""
    saved = table(spark, d, "events").select("event_id", F.expr(_STATE.replace("{string}", "STRING")).alias("s"))
    return S.migrated(saved, "s").select("event_id", "seen", "translate", "chat", "day", "mode", "tab")
