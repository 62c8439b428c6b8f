"""Admission against plain models, and keys of very many requests."""

import random

from pyspark.sql import functions as F

from parchment.operators import admission as A

WINDOW, MOST = 1000, 3
LIMITS = {"chat": (900, 2600), "translate": (40, 90)}  # a client's day, all clients' day


def model(rows):
    """rows in any order -> {id: (outcome, retry)}, by the order of gates, one request after the other."""
    windows, days, own, out = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["ms"], r["id"])):
        e, c = r["endpoint"], r["client"]
        start, n = windows.get((e, c), (None, 0))
        if start is None or r["ms"] >= start + WINDOW:
            start, n = r["ms"], 0
        windows[e, c] = start, n + 1
        text = (r["message"] or "").strip()
        chars = len(text) + (r["context_chars"] or 0 if e == "chat" else 0)
        g, k = (min(chars, 30_000), min(chars, 5000)) if e == "chat" else (chars, chars)
        retry = start + WINDOW - r["ms"] if n + 1 > MOST else 0
        if n + 1 > MOST:
            why = "throttled"
        elif r["body"] in (None, "{", "x"):
            why = "bad_json"
        elif r["body"] in ("[]", "3", "null"):
            why = "bad_body"
        elif not text:
            why = "empty"
        elif len(text) > (2000 if e == "chat" else 3000):
            why = "too_long"
        elif e == "chat" and r["suspect"]:
            why = "screened"
        elif days.get((e, r["day"]), 0) + g > LIMITS[e][1]:
            why = "global"
        else:
            days[e, r["day"]] = days.get((e, r["day"]), 0) + g
            if own.get((e, c, r["day"]), 0) + k > LIMITS[e][0]:
                why = "client"
            else:
                own[e, c, r["day"]] = own.get((e, c, r["day"]), 0) + k
                why = "ok"
        out[r["id"]] = why, retry
    return out


SCHEMA = "endpoint string, client string, ms bigint, day string, id bigint, body string, message string, suspect boolean, context_chars bigint"


def test_full_admission_equals_the_model(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        ms = rng.randint(0, 60_000)
        rows.append(
            {
                "endpoint": rng.choice(["chat", "translate"]), "client": rng.choice(["a", "b", "c", "dd", "e e", None]), "ms": ms, "day": f"d{ms // 20_000}", "id": i,
                "body": rng.choice(["{}"] * 12 + ['{"a": [1]}', "{", "x", "[]", "3", "null", None]), "message": rng.choice(["hi", " hello there\n", "x" * 30, "y" * 2001, "z" * 3001, "  ", "", None, "ok"]),
                "suspect": rng.choice([True, False, False, False, None]), "context_chars": rng.choice([0, 10, 100, 700, None]),
            }
        )
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(4)
    chat = F.col("endpoint") == "chat"
    got = A.admission_full(df, F.when(chat, LIMITS["chat"][0]).otherwise(LIMITS["translate"][0]), F.when(chat, LIMITS["chat"][1]).otherwise(LIMITS["translate"][1]), WINDOW, MOST).collect()
    want = model(rows)
    assert {r.id: (r.outcome, r.retry_after_ms) for r in got} == want and len(got) == len(rows)
    assert {w for w, _ in want.values()} == {"throttled", "bad_json", "bad_body", "empty", "too_long", "screened", "global", "client", "ok"}
    assert A.admission_full(df.limit(0), F.lit(1), F.lit(1)).count() == 0


def test_a_client_denial_keeps_the_global_charge(spark):
    rows = [("e", "d", c, t, t, n) for t, (c, n) in enumerate([(1, 60), (1, 60), (2, 60), (2, 30), (3, 10)])]
    df = spark.createDataFrame(rows, "endpoint string, day string, client bigint, ms bigint, id bigint, chars bigint")
    got = {r.id: r.outcome for r in A.admission(df, 100, 200).collect()}
    assert got == {0: "ok", 1: "client", 2: "ok", 3: "global", 4: "ok"}


def test_a_key_of_a_million_requests(spark):
    """One state a key: nothing of it is gathered, and the time is linear."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("key"), F.col("id"), (F.col("id") * 7).alias("ms"), (F.col("id") % 5).alias("chars"))
    r = A.throttle(df, window_ms=700, most=30).agg(F.count_if("denied"), F.count("*")).first()
    assert tuple(r) == (n // 100 * 70, n)
    q = A.quota(df, ["key"], F.lit(1_000_003)).agg(F.max("used"), F.count_if("allowed"), F.count("*")).first()
    assert q[0] == 1_000_003 and q[2] == n


def test_plans_gather_no_key(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "key int, id bigint, ms bigint, chars bigint")
    for out in (A.throttle(df), A.quota(df, ["key"], F.lit(3))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange") == 1
