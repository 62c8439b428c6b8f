"""Search while documents are still being read: pages arrive, results are shown early and settled once.

``snapshots`` holds the pages of each document that is being read as keyed state. It hands the document on,
whole so far, each time that ``every`` more pages have come, and once more when it is complete;
pages may come in any order and more than once, only what has no gap before it is handed on. With a
watermark, a document whose pages stop coming is handed on as ``failed`` once event time is
``patience_ms`` past its newest page, with the pages that it has. State is then let go; late pages of a settled
document change nothing until the same time has passed again.

``progressive_search`` searches what is handed on with the batch operators: of several states of a
document in one micro-batch only the newest is searched (a search that is about to be replaced is not
begun), and the one of a complete document is authoritative. Results are written by batch, in a folder
that a repeated batch overwrites, so a restart neither loses nor doubles any; ``current`` reads the newest of each
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parchment.operators import search as S
from parchment.sources.tables import LINES_PER_PAGE

EVERY = 5
PATIENCE_MS = 60_000
SNAPSHOT = "doc_id bigint, version int, status string, text string"
STATE = "numbers array<int>, texts array<string>, n_pages int, sent int, newest bigint, done boolean"


def page_rows(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, page, n_pages, text): a row for each page, blank ones too, its lines as they are."""
    ls = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", ls.alias("ls")).withColumn("n_pages", F.ceil(F.size("ls") / LINES_PER_PAGE).cast("int"))
    rows = rows.select("doc_id", "ls", "n_pages", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))
    return rows.select("doc_id", "page", "n_pages", F.array_join(F.slice("ls", (F.col("page") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n").alias("text"))


def snapshots(pages: DataFrame, every: int = EVERY, watermark: str | None = None, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """pages (doc_id, page, n_pages, text[, ts]) -> (doc_id, version, status, text): version counts pages, status is progress, final or failed."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState):
        numbers, texts, n_pages, sent, newest, done = state.get if state.exists else ([], [], 0, 0, 0, False)
        have = dict(zip(numbers, texts))
        out = []

        def whole(n: int) -> str:
            return "\n".join(have[p] for p in range(1, n + 1))

        def run_of_pages() -> int:
            n = 0
            while n + 1 in have:
                n += 1
            return n

        if state.hasTimedOut:
            if not done:
                n = run_of_pages()
                yield pd.DataFrame([(key[0], n, "failed", whole(n))], columns=["doc_id", "version", "status", "text"])
            state.remove()
            return
        for part in parts:
            for page, n, text in zip(part.page, part.n_pages, part.text):
                n_pages = max(n_pages, int(n))
                have.setdefault(int(page), text)
            if watermark and len(part):
                newest = max(newest, int(part.ts.max().timestamp() * 1000))
        if not done:
            n = run_of_pages()
            out += [(key[0], k, "progress", whole(k)) for k in range(sent + every, n + 1, every)]
            sent = n // every * every
            if n_pages and n >= n_pages:
                out.append((key[0], n, "final", whole(n)))
                done = True
        if done:
            have = {}
        if done and not watermark:
            state.update(([], [], n_pages, sent, newest, True))
        else:
            state.update((list(have), list(have.values()), n_pages, sent, newest, done))
        if watermark:
            state.setTimeoutTimestamp(max(newest + patience_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "version", "status", "text"])

    df = pages.withWatermark("ts", watermark) if watermark else pages
    mode = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return df.groupBy("doc_id").applyInPandasWithState(run, SNAPSHOT, STATE, "append", mode)


def newest(rows: DataFrame) -> DataFrame:
    """Of each document's rows (doc_id, version, status, ..) the one that replaces the others."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.col("status") != "progress"), F.desc("version"))
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def progressive_search(pages: DataFrame, terms: list[tuple[str, str, str]], out: str, checkpoint: str, case_sensitive: bool = False, every: int = EVERY, watermark: str | None = None, patience_ms: int = PATIENCE_MS) -> StreamingQuery:
    """Starts the search over what has come (available now); results go below ``out``."""

    def search(batch: DataFrame, number: int) -> None:
        batch = newest(batch).persist()
        try:
            batch.select("doc_id", "version", "status").write.mode("overwrite").parquet(f"{out}/states/batch={number}")
            S.search_terms(batch.select("doc_id", "text"), terms, case_sensitive).write.mode("overwrite").parquet(f"{out}/matches/batch={number}")
        finally:
            batch.unpersist()

    return snapshots(pages, every, watermark, patience_ms).writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(states, matches): of each document the newest state and that state's matches."""
    states = newest(spark.read.parquet(f"{out}/states"))
    matches = spark.read.parquet(f"{out}/matches")
    return states, matches.join(states.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")
