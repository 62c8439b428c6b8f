import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from parchment.llm import periodic_runs as P
from parchment.llm import queries as Q


def brute(words, min_exp=3, min_length=24):
    """Every stretch tested as the definition says."""
    n, found = len(words), set()
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exp * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                    found.add((i, length, q))
            i = max(j, i + 1)
    return found


def texts(rng):
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            block = [rng.choice("abcde") for _ in range(rng.randint(1, 12))]
            words += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))] + [rng.choice("xyz") for _ in range(rng.randint(0, 5))]
        yield words
    for period in (1, 2, 7, 8, 40, 65, 130):  # periods around the octaves, runs cut at each place
        for length in (3 * period - 1, 3 * period, 3 * period + 1, 5 * period + 2, 24, 23):
            body = [f"w{i % period}" for i in range(length)]
            yield ["a", "b", *body, "c"]
    yield ["a"] * 700
    yield (["a"] * 30 + ["b"]) * 20  # runs inside the periods of a run


def test_find_runs_equals_the_definition():
    rng = random.Random(3)
    for words in texts(rng):
        ids = P.word_ids([w.encode() for w in words])
        assert P.find_runs(ids) == brute(words)
        cuts = sorted({1, *(rng.randint(1, 80) for _ in range(3))})
        parts = [P.find_runs(ids, a, b) for a, b in zip(cuts, [*cuts[1:], 10**9])]
        assert set().union(*parts) == brute(words)
    assert P.find_runs(P.word_ids([b"a", b"b"] * 6), min_exp=2, min_length=4) == {(0, 12, 2)}


def test_large_runs_are_compared_once():
    ids = np.zeros(300_000, np.int32)
    assert P.find_runs(ids) == {(0, 300_000, 1)}
    ids = np.arange(300_000, dtype=np.int32) % 6
    ids[200_000:] = np.arange(100_000) % 5 + 10
    assert P.find_runs(ids) == {(0, 200_000, 6), (200_000, 100_000, 5)}


def expected(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


FIELDS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_and_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue x", "é"]) for _ in range(rng.randint(1, 90)))) for i in range(120)]
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(texts(rng)) if i % 3 == 0]
    rows += [(None, "a b " * 20), (None, None), (7, None), (8, ""), (9, " \t\n "), (10, "x " * 30), (10, "x " * 30), (10, "y"), (11, "a\x0bb\x0cc\rd\n" * 12)]
    docs = spark.createDataFrame([(t, 0, d) for d, t in rows], "text string, runs int, doc_id bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*FIELDS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*r)) for r in rows)
    assert Q.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).filter("false").count() == 0


def test_lag_ranges_give_the_same_rows(spark):
    rng = random.Random(5)
    rows = [(i % 7, " ".join(w)) for i, w in enumerate(texts(rng)) if i % 2 == 0] + [(None, "q w e " * 40), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole, dealt = P.periodic_runs(docs), P.periodic_runs(docs, long_bytes=20)
    assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.collect()))
    empty = docs.limit(0)
    assert P.periodic_runs(empty).count() == 0
