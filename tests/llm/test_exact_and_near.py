import hashlib
import random
import re

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from parchment.llm import exact_dedup, near_copies, simhash
from parchment.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(1)
    base = ["", " ", "a b", "ab", "a\tb ", "é x", "éx", None, "x" * 5000, "x" * 4999 + " x", "x" * 4999 + "y"]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(7, "ab"), (None, "only"), (None, "a b"), (301, "on ly")]
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(rows)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(frame(spark, [(1, "a b"), (2, "ab"), (3, "c")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "lang"]


def test_trie_shares_terminals_and_splits_edges():
    t = exact_dedup.PatriciaTrie()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 1000, b"b" * 999 + b"c"]
    nodes = {k: t.insert(k) for k in keys}
    assert len({id(n) for n in nodes.values()}) == len(keys)
    assert all(t.insert(k) is nodes[k] for k in keys)


def test_chunks_that_are_let_go_early_change_nothing(spark):
    rows = [(i, "text %d" % (i % 7)) for i in range(200)]
    df = frame(spark, rows).select("doc_id", F.length("text").cast("bigint").alias("cp"), F.encode("text", "UTF-8").alias("t"))
    local = df.mapInArrow(lambda b: exact_dedup._local(b, 2000), exact_dedup.LOCAL)
    assert local.count() == 200 and local.filter("norm is not null").count() > 7


def brute_fp(text):
    ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low.setdefault(find(i), []).append(d)
    return [min(low[find(i)]) for i in range(len(ids))]


def test_near_groups_against_brute_force(spark):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(60)]
    rows = []
    for k in range(40):
        doc = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 60, 200]))]
        rows.append((k * 10, " ".join(doc)))
        for m in range(3):
            other = list(doc)
            other[rng.randrange(len(other))] = "Edit%d" % m
            rows.append((k * 10 + m + 1, "  ".join(other)))
    rows += [(900, ""), (901, None), (902, " \t"), (903, "W1 ÉA é"), (904, "w1 Éa é")]
    fps = [brute_fp(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(frame(spark, rows).repartition(3)).collect()}
    assert got == {i: (f, c) for (i, _), f, c in zip(rows, fps, want)}


def test_links_over_crafted_fingerprints_and_split_anchors(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    want = brute_components(signed, fps)
    for hot in (4096, 1):
        roots = {r.node: r.root for r in components(simhash.link(df, hot_homes=hot)).collect()}
        assert [roots.get(f, f) for f in signed] == want


def test_near_groups_of_nothing(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    out = near_copies.drop_near_copies(frame(spark, [(5, "a b c d"), (3, "A b  c d"), (9, "q r s t u"), (None, "zz")]))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 3, 9]
    assert near_copies.drop_near_copies(frame(spark, [])).count() == 0


def test_drops_go_by_row(spark):
    """An id that two texts share, rows repeated in all, null ids, and a column that no step may trip over."""
    rows = [(3, "A b c d e f", 1), (5, "A b c d e f", 2), (5, "quite another text", 3), (7, "zz yy", 1), (7, "zz yy", 1), (None, "zz yy", 1), (None, "q q", 1), (8, None, 0), (9, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int").repartition(3)
    want = sorted([(3, "A b c d e f", 1), (5, "quite another text", 3), (7, "zz yy", 1), (8, None, 0), (None, "q q", 1)], key=str)
    for drop in (near_copies.drop_near_copies, exact_dedup.drop_copies):
        out = drop(df)
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == want


def shingle_sets(rows):
    out = []
    for _, t in rows:
        ws = (t or "").lower().split()
        out.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    return out


def brute_groups(rows, similarity=0.8):
    """Smallest row number connected, by the exact similarity of all pairs."""
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def similar_rows(rng):
    """Copies of every similarity from some 0.5 to 1, chains, boilerplate, and words said again and again."""
    vocab = ["w%d" % k for k in range(3000)]
    rows = []
    for g in range(24):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 60, 150, 400]))]
        rows.append((10 * g, " ".join(base)))
        for k, share in enumerate((0.0, 0.004, 0.01, 0.02, 0.03, 0.045, 0.06), 1):
            rows.append((10 * g + k, " ".join(rng.choice(vocab) if rng.random() < share else w for w in base)))
    part = [rng.choice(vocab) for _ in range(300)]
    rows += [(1000 + k, " ".join(part + [rng.choice(vocab) for _ in range(n)])) for k, n in enumerate([10, 40, 75, 80, 100, 120] * 10)]
    rows += [(2000 + k, "de " * 200 + " ".join(rng.choice(vocab) for _ in range(20))) for k in range(10)]
    rows += [(3000, "one two"), (3001, "One  two"), (3002, None), (3003, " ")]
    return rows


def test_similar_documents_are_found_and_no_others(spark):
    """All pairs of similarities around 0.8, against exact Jaccard similarity."""
    rows = similar_rows(random.Random(4))
    want, sets = brute_groups(rows), shingle_sets(rows)
    at = {d: k for k, (d, _) in enumerate(rows)}
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    between = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(0, len(rows), 3) for j in range(i) if sets[i]]
    assert sum(0.75 < x < 0.85 for x in between) > 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for kw in ({}, {"hot_homes": 2}, {"plan": (32, 40)}):
        group = {at[r.doc_id]: r.group for r in near_copies.similar_groups(df, **kw).collect()}
        assert sum(group[i] == group[j] for i, j in near) >= 0.98 * len(near)
        first = {}
        for k in range(len(rows)):  # nobody is grouped with another without a chain of pairs at 0.8
            assert want[first.setdefault(group[k], k)] == want[k]


def test_blocks_and_cells_of_left_overs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "QUERIES", 3)
    monkeypatch.setattr(near_copies, "MEMBERS", 5)
    rows = similar_rows(random.Random(6))[-200:]
    want = brute_groups(rows)
    at = {d: k for k, (d, _) in enumerate(rows)}
    group = {at[r.doc_id]: r.group for r in near_copies.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    first = {}
    for k in range(len(rows)):
        assert want[first.setdefault(group[k], k)] == want[k]
    assert len(set(group.values())) <= 1.05 * len(set(want))


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(50)] + [(1000, k) for k in range(2000, 2100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000: 1000} | {k: 1000 for k in range(2000, 2100)}
