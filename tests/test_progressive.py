"""Progressive search: streams in any order, restarts and watermarks against the batch search."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parchment.operators import search as S
from parchment.streaming import progressive as P

TERMS = [("of the", "c1", "of the"), ("onthe", "c2", "onthe"), ("thing", "c3", "thing"), ("인공지능", "c4", "ai"), ("C++", "c5", "C++"), (" ", "c6", "blank")]
COLS = ["doc_id", "page", "item_index", "start", "matched", "context", "char_start", "char_end", "tier", "label", "id"]


def documents(rng):
    lines = ["a thing of the past", "on the road", "on-the move", "인공 지능 C++ things", "", "   ", "Thing, of the C++", "nothing here", "onthe spot", "인공", "지능이다", "thingz"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 4, 5, 6, 26, 40, 61])))) for i in range(30)]
    return [*docs, (100, ""), (101, None), (102, "on the\n" * 12), (103, "onthe\n" + "on the\n" * 12)]


def write(spark, rows, schema, folder, k):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{k}")


def batch(df):
    return sorted(map(str, map(tuple, S.search_terms(df, TERMS).select(COLS).collect())))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    docs = documents(rng)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    pages = [tuple(r) for r in P.page_rows(df).collect()]
    schema = "doc_id bigint, page int, n_pages int, text string"
    rng.shuffle(pages)
    pages += pages[:40]  # some come twice
    parts = [pages[k::5] for k in range(5)]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = lambda: P.progressive_search(stream(), TERMS, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    for k in (0, 1):
        write(spark, parts[k], schema, f"{tmp_path}/in", k)
    run()
    states, early = P.current(spark, f"{tmp_path}/out")
    shown = {r.doc_id: r for r in states.collect()}
    # what is shown early is the search over the pages without a gap
    known = {}
    for d, p, _, t in parts[0] + parts[1]:
        known.setdefault(d, {})[p] = t
    so_far = [(d, "\n".join(known[d][p] for p in range(1, r.version + 1))) for d, r in shown.items()]
    assert batch(spark.createDataFrame(so_far, "doc_id bigint, text string")) == sorted(map(str, map(tuple, early.select(COLS).collect())))
    for k in (2, 3, 4):
        write(spark, parts[k], schema, f"{tmp_path}/in", k)
    run()  # goes on from the checkpoint
    states, matches = P.current(spark, f"{tmp_path}/out")
    assert {r.doc_id: r.status for r in states.collect()} == {d: "final" for d, _ in docs}
    got = sorted(map(str, map(tuple, matches.select(COLS).collect())))
    assert got == batch(df) and {"ai", "C++", "onthe", "thing", "of the"} <= {r.label for r in matches.collect()}
    run()  # nothing new
    assert got == sorted(map(str, map(tuple, P.current(spark, f"{tmp_path}/out")[1].select(COLS).collect())))


def test_five_page_states_in_order(spark, tmp_path):
    text = "\n".join(f"line {i}" for i in range(60))  # twelve pages
    pages = [tuple(r) for r in P.page_rows(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("page").collect()]
    schema = "doc_id bigint, page int, n_pages int, text string"
    for k, part in enumerate([pages[:4], pages[4:11], pages[11:]]):
        write(spark, part, schema, f"{tmp_path}/in", k)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = P.snapshots(s).writeStream.format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.version, r.status, r.text) for r in spark.table("states").collect())
    ls = text.split("\n")
    assert got == [(5, "progress", "\n".join(ls[:25])), (10, "progress", "\n".join(ls[:50])), (12, "final", text)]


def test_a_document_that_stops_coming_fails_and_late_pages_change_nothing(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    schema = "doc_id bigint, page int, n_pages int, text string, ts timestamp"
    parts = [
        [(1, 1, 3, "on the", at(0)), (1, 3, 3, "thing", at(1)), (2, 1, 1, "thing", at(2))],
        [(3, 1, 1, "a thing", at(300))],  # event time goes on
        [(3, 1, 1, "a thing", at(301)), (4, 1, 2, "of the", at(600))],
        [(5, 1, 1, "x", at(900))],
    ]
    for k, part in enumerate(parts):
        write(spark, part, schema, f"{tmp_path}/in", k)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = P.snapshots(s, watermark="10 seconds", patience_ms=60_000).writeStream.format("memory").queryName("lost").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.doc_id, r.version, r.status, r.text) for r in spark.table("lost").collect())
    assert got == [(1, 1, "failed", "on the"), (2, 1, "final", "thing"), (3, 1, "final", "a thing"), (4, 1, "failed", "of the"), (5, 1, "final", "x")]
    kept = [r.asDict() for r in spark.read.format("statestore").load(f"{tmp_path}/ck").select(F.col("key.doc_id").alias("d")).collect()]
    assert {r["d"] for r in kept} <= {5}  # the state of the others is let go
