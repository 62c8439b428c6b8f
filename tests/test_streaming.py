"""Streams against the batch operators on the same rows, over several micro-batches."""

import random

from pyspark.sql import functions as F

from parchment.operators import admission as A
from parchment.streaming import admission as SA
from parchment.streaming.pages import stream_matches


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def source(spark, rows, schema, tmp_path, parts=3):
    df = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_throttle_and_quota(spark, tmp_path):
    rng = random.Random(4)
    times = sorted(rng.randrange(20_000) for _ in range(240))
    rows = [(i, rng.randrange(5), t, f"2026-01-0{1 + (t >= 9000)}", rng.randrange(1, 60)) for i, t in enumerate(times)]
    df, stream = source(spark, rows, "id bigint, key bigint, ms bigint, day string, chars bigint", tmp_path)
    got = drain(spark, SA.throttle_stream(stream, 700, 3), "throttled", tmp_path)
    want = A.throttle(df, window_ms=700, most=3)
    cols = ["key", "id", "denied", "retry_after_ms"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    got = drain(spark, SA.quota_stream(stream, 300), "counted", tmp_path)
    cols = ["key", "day", "id", "allowed", "used"]
    want = A.quota(df, ["key", "day"], F.lit(300))
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_matches(spark, tmp_path):
    rows = [(i, "the model of things\nModels and a thing") for i in range(6)]
    df, stream = source(spark, rows, "doc_id bigint, text string", tmp_path)
    cols = ["doc_id", "page", "item_index", "start", "matched", "tier", "term_ord"]
    got = drain(spark, stream_matches(stream, ["model", "thing"]), "matched", tmp_path).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stream_matches(df, ["model", "thing"]).select(cols).collect())) and got
