import itertools
import math

import numpy as np
import pytest

from parchment.llm import lattice_dedup as L
from parchment.llm import queries as Q


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.95):
    """n_links and component of every row, over all pairs."""
    units = []
    for k, (_, v) in enumerate(rows):
        if usable(v):
            x = np.array(v, np.float64)
            x /= np.abs(x).max()
            units.append((k, x / np.sqrt(x @ x)))
    links = {k: set() for k in range(len(rows))}
    for (i, a), (j, b) in itertools.combinations(units, 2):
        if len(a) == len(b) and a @ b >= cosine - 1e-12:
            links[i].add(j), links[j].add(i)
    out, seen = [None] * len(rows), set()
    for k in links:
        if k in seen:
            continue
        group, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        seen |= group
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        low = min(ids) if ids else None
        for x in group:
            out[x] = (rows[x][0], len(links[x]), low, rows[x][0] == low)
    return out


def near(rng, v, cosine):
    z = rng.normal(size=len(v))
    u = v / np.linalg.norm(v)
    z -= (z @ u) * u
    return cosine * u + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def fixture():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    rows = [v.tolist() for v in base]
    hot = base[0] / np.linalg.norm(base[0])
    rows += [(hot + 0.2 * rng.normal(size=64) / 8).tolist() for _ in range(140)]  # one group, its pairs about 0.96
    for k in range(1, 60):
        rows += [near(rng, base[k], c).tolist() for c in (0.955, 0.99, 0.9)]
        if k % 5 == 0:
            rows += [(base[k] * 7).tolist(), base[k].tolist()]  # the same direction, the same vector
    rows += [[1e300] * 64, [2e300] * 64, [1e-300] * 64, [0.0] * 64, None, [], [None] + [1.0] * 63, [math.inf] + [1.0] * 63, [math.nan] * 64]
    rows += [[1.0], [2.0], [-3.0], [0.3] * 5, [0.3] * 5, [float(i) for i in range(1000)], [float(i) + 0.01 for i in range(1000)]]
    ids = rng.permutation(len(rows)).tolist()
    out = [(i, v) for i, v in zip(ids, rows)] + [(None, rows[1]), (None, [0.0, 5.0, 1.0]), (None, None), (3, rows[2]), (3, rows[2])]
    return out


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = L.nearest_point(x)
    own = ((x - p) ** 2).sum(axis=1)
    assert (own <= ((x[:, None, :] - (p[:, None, :] + L.roots()[None])) ** 2).sum(axis=2).min(axis=1) + 1e-12).all()
    assert L.roots().shape == (240, 8) and ((L.roots() ** 2).sum(axis=1) == 2).all()
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (p.sum(axis=1) % 2 == 0)).all()


@pytest.mark.parametrize("cosine", [0.95, 0.97])
def test_pairs_at_the_threshold_meet(cosine):
    rng = np.random.default_rng(2)
    lattice = L.Lattice(64, L.TABLES, L.BLOCKS, L.PROBES, L.SCALE)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([near(rng, v, cosine) for v in x])
    a, b = lattice.cells(x), lattice.cells(y)
    met = ((b == a[:, :, :1]).any(axis=2) | (a == b[:, :, :1]).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.999
    far = ((np.roll(b, 1, axis=0) == a[:, :, :1]).any(axis=2)).any(axis=1)
    assert far.mean() < 0.01


@pytest.mark.parametrize("hot", [L.HOT_HOMES, 9])
def test_groups_equal_all_pairs(spark, hot):
    rows = fixture()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, node int, cell int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # cells go on through several batches
    try:
        got = L.vector_groups(df, hot_homes=hot).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(n for _, n, _, _ in want) > 10_000


def test_query_reads_floats_and_no_rows(spark, tmp_path):
    rows = [(i, v) for i, v in fixture() if v is None or len(v) == 64][:300]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Q.QUERIES["op12_embedding_dedup"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    f32 = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(f32)))
    assert L.vector_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
