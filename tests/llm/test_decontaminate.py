import random
import re

from parchment.llm import decontaminate as D


def ws(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def brute(docs, bench):
    items = [(i, ws(t)) for i, t in bench if ws(t)]
    wins = {(tuple(w[k : k + min(10, len(w))]), i) for i, w in items for k in range(len(w) - min(10, len(w)) + 1)}
    out = []
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for g, i in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, bench):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, h string"), spark.createDataFrame(bench, "item_id bigint, text string")


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice("alpha Beta gamma délta 42 omega".split())
    bench = [(i, " ".join(word() for _ in range(rng.choice([10, 12, 25])))) for i in range(12)] + [(20, None), (21, "..."), (22, "tiny Item"), (23, "Tiny-item")]
    docs = []
    for d in range(60):
        t = " ".join(word() for _ in range(rng.choice([0, 5, 30, 80])))
        if d % 3 == 0:
            t += ", " + bench[rng.randrange(12)][1].upper().replace("É", "é") + "! " + t
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "x tiny  item y"), (102, "x tiny  item y"), (102, "clean"), (None, "tiny item")]
    return docs, bench


def test_contamination_against_brute_force(spark):
    docs, bench = cases()
    for most in (2_000_000, 0):
        d, b = frames(spark, docs, bench)
        got = D.contamination(d, b, broadcast_windows=most).select("doc_id", "n_words", "n_hit", "items", "contaminated")
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, bench)


def test_drop_and_cut(spark):
    docs, bench = cases()
    d, b = frames(spark, docs, bench)
    want = sorted(str(x[0]) for x in brute(docs, bench) if not x[4])
    kept = D.drop_contaminated(d, b)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and kept.columns == d.columns
    cut = D.remove_spans(d, b)
    assert cut.count() == len(docs)
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id in (100, 101, 102, 1)}
    assert texts[100] is None and texts[1] == dict(docs)[1]
    assert sorted(r.text for r in cut.filter("doc_id = 102").collect()) == ["clean", "x y", "x y"]


def test_empty_tables(spark):
    docs, bench = cases()
    d, b = frames(spark, docs, [])
    assert D.contamination(d, b).filter("contaminated").count() == 0 and D.contamination(d, b).count() == len(docs)
    d, b = frames(spark, [], bench)
    assert D.contamination(d, b).count() == 0


def test_a_set_over_its_bytes_gives_the_same_rows(spark):
    docs, bench = cases()
    d, b = frames(spark, docs, bench)
    rows = lambda f: sorted(map(str, f.select("doc_id", "th", "n_words", "at", "size", "items").collect()))
    assert rows(D.find_hits(d, b)) == rows(D.find_hits(d, b, broadcast_bytes=100))
    plan = D.find_hits(d, b, broadcast_bytes=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "bench_ws" not in plan
