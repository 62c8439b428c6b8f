import itertools
import random

import numpy as np

from parchment.llm import packing as P


def brute(lengths, counts, buckets):
    n, best = len(lengths), None
    for k in range(1, min(buckets, n) + 1):
        for cut in itertools.combinations(range(n - 1), k - 1):
            ends = [*cut, n - 1]
            cost = sum(c * (lengths[next(e for e in ends if e >= i)] - x) for i, (x, c) in enumerate(zip(lengths, counts)))
            best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 20) for _ in lengths])
        k = rng.randint(1, 9)
        bounds, padding = P.optimal_bounds(lengths, counts, k)
        assert padding == brute(list(lengths), list(counts), k) and len(bounds) <= k and bounds[-1] == lengths[-1]
        assert padding == sum(int(c) * (next(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))


def test_pieces_and_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 5, 90, 100, 101, 250, 1000])) for i in range(400)] + [(3, 5), (3, 5), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    kw = {"max_tokens": 100, "buckets": 4, "token_budget": 300}
    out = P.pack_lengths(df.repartition(5), shard_rows=40, **kw).collect()
    assert sum(r.length for r in out) == sum(n for _, n in rows)
    for d in (8, 17, 44):
        got = sorted((r.start, r.length) for r in out if r.doc_id == d)
        n = dict(rows)[d]
        assert got == [(s, min(100, n - s)) for s in range(0, n, 100)]
    batches = {}
    for r in out:
        batches.setdefault((r.bucket, r.batch), []).append(r)
        assert r.length <= r.padded
    sizes = {}
    for (bucket, batch), members in batches.items():
        assert sum(m.padded for m in members) <= 300
        assert sorted(m.slot for m in members) == list(range(len(members)))
        sizes.setdefault(bucket, {})[batch] = len(members)
    for bucket, by in sizes.items():  # dense: all but the last batch are full
        full = max(by.values())
        assert sorted(by) == list(range(len(by))) and all(by[b] == full for b in sorted(by)[:-1])
    again = P.pack_lengths(df.repartition(2), shard_rows=40, **kw).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_nothing_to_pack(spark):
    assert P.pack_lengths(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Some words here."), (4, "x " * 9000)], "doc_id bigint, text string")
    out = P.pack(docs).collect()
    assert {r.doc_id for r in out} == {3, 4} and max(r.length for r in out) <= P.MAX_TOKENS
