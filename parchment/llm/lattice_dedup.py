"""Embedding near-dedup by lattice hashing: vectors whose cosine is at least ``cosine`` are linked.

Search: in each of ``tables`` tables a vector is projected on ``blocks`` times 8 random orthonormal
directions, and each 8 of them are decoded to the nearest point of the lattice E8, scaled
with the vector's length in dimensions. The points are its home cell. It also probes the
neighbouring cells that its projection is nearest to: the lattice's 240 shortest vectors away,
in one or more blocks, ``probes`` of them by added squared distance. Two vectors meet where the home
of one is among the cells of the other; their cosine is then computed in double precision.

Pairs of cosine 0.95 in 64 dimensions meet in a table with probability 0.71, in one of the six
with 0.9998 (0.97: above 0.9999); two unrelated vectors meet in a table with probability 2.3e-5,
which is what grows with the square of the input. ``blocks=3, probes=31, scale=0.25`` bring that to 6e-7 at 0.9965,
for twice the rows. The query's recall against all pairs is in the tests.

Skew: equal vectors are one row from the start. Cells without a partner are dropped before
any vector is moved. A cell that is home to over ``hot_homes`` vectors is split: its homes are
salted, all of its members go to each salt as guests. In a task homes are held and guests
stream past in blocks; links are counted and reduced to a spanning forest at once, so a group of
n like vectors leaves a task as some n rows. A pair that meets in several cells is counted in the
smallest of them, which both vectors' cells tell, so that counts add up without the pairs being
written. Within a group all pairs are still compared, as each vector's links are asked for.

Results for odd input: vectors that are null, empty or zero, or hold null or non-finite components link
with nothing and stay; vectors of another length never meet; components of any size are scaled
before they are squared; a null vec_id names a component only if no member has an id; rows that repeat
a vec_id are each a vector; long vectors are read whole; columns other than the two named are
not read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parchment.llm.components import components
from parchment.llm.rows import col
from parchment.llm.simhash import forest
from parchment.llm.storage import release, store

COSINE = 0.95
TABLES, BLOCKS, PROBES, SCALE = 6, 2, 15, 0.22
SEED = 8
HOT_HOMES = 1024
#: Rows that stream past the homes of a cell at once, and pairs whose cells are looked through at once.
GUESTS, PAIRS = 4096, 16384


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if s.count(-0.5) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points whose coordinates have an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even integer points, and those shifted by one half in all coordinates."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _mixed(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _smallest(cost: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of each row, in order."""
    at = np.argpartition(cost, k - 1, axis=1)[:, :k] if k < cost.shape[1] else np.tile(np.arange(cost.shape[1]), (len(cost), 1))
    return np.take_along_axis(at, np.take_along_axis(cost, at, 1).argsort(axis=1, kind="stable"), 1)


class Lattice:
    """The tables' directions for vectors of one length; cells(units) -> (n, tables, 1 + probes), homes first."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float):
        self.width = max(dim, 8 * blocks)
        self.roots, self.blocks, self.probes = roots(), blocks, probes
        self.seed = dim
        side = scale * 8 / dim**0.5
        rng = np.random.default_rng([SEED, dim])
        self.directions = [np.linalg.qr(rng.normal(size=(self.width, 8 * blocks)))[0] / side for _ in range(tables)]

    def _options(self, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, added squared distance) of a block's nearest point and its neighbours, nearest first."""
        point = nearest_point(y)
        added = np.concatenate([np.zeros((len(y), 1)), 2 - 2 * (y - point) @ self.roots.T], axis=1)
        at = _smallest(added, most)
        steps = np.concatenate([np.zeros((1, 8)), self.roots])
        points = np.rint(2 * (point[:, None, :] + steps[at])).astype(np.int64)
        keys = np.zeros(at.shape, np.uint64)
        for k in range(8):
            keys = _mixed(keys, points[:, :, k])
        return keys, np.take_along_axis(added, at, 1)

    def cells(self, units: np.ndarray) -> np.ndarray:
        if units.shape[1] < self.width:
            units = np.pad(units, ((0, 0), (0, self.width - units.shape[1])))
        most, out = self.probes + 1, []
        for t, directions in enumerate(self.directions):
            y = units @ directions
            keys = np.full((len(units), 1), (self.seed << 16) + t, np.uint64)
            cost = np.zeros((len(units), 1))
            for b in range(self.blocks):
                own, added = self._options(y[:, 8 * b : 8 * b + 8], min(most, 241))
                total = (cost[:, :, None] + added[:, None, :]).reshape(len(units), -1)
                every = _mixed(keys[:, :, None], own[:, None, :]).reshape(len(units), -1)
                at = _smallest(total, min(most, total.shape[1]))
                keys, cost = np.take_along_axis(every, at, 1), np.take_along_axis(total, at, 1)
            out.append(keys)
        return np.stack(out, axis=1).view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()  # nulls come as NaN
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        units: list[bytes | None] = [None] * len(size)
        for dim in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == dim)
            x = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
            with np.errstate(all="ignore"):
                high = np.abs(x).max(axis=1)
                ok = np.isfinite(high) & (high > 0)
                rows, x = rows[ok], x[ok] / high[ok][:, None]
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            for r, u in zip(rows.tolist(), x):
                units[r] = u.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.binary())], names=["vec_id", "unit"])


def _marked(tables: int, blocks: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for b in batches:
            units = b.column(1).to_pylist()
            size = np.array([len(u) for u in units], np.int64)
            cells: list[bytes | None] = [None] * len(units)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                if n not in made:
                    made[n] = Lattice(n // 8, tables, blocks, probes, scale)
                lattice = made[n]
                for at in range(0, len(rows), GUESTS):
                    part = rows[at : at + GUESTS].tolist()
                    found = lattice.cells(np.frombuffer(b"".join(units[r] for r in part), np.float64).reshape(len(part), -1))
                    for r, c in zip(part, found):
                        cells[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cells, pa.binary())], names=["node", "unit", "weight", "cells"])

    return run


def _spread(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            cells = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            home = np.tile(np.arange(probes + 1) == 0, tables * len(node))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.repeat(node, tables * (probes + 1))), pa.array(home)], names=["cell", "node", "home"])

    return run


def _first_meeting(cell: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``cell`` is the smallest in which the pairs of cells a[k], b[k] (tables, 1 + probes) meet."""
    last = np.iinfo(np.int64).max
    ours, theirs = a[:, :, 0], b[:, :, 0]
    low = np.where((b == ours[:, :, None]).any(axis=2), ours, last).min(axis=1)
    high = np.where((a == theirs[:, :, None]).any(axis=2), theirs, last).min(axis=1)
    return np.minimum(low, high) == cell


class _Members:
    """Vectors of one cell: nodes, units, weights, cells, and whether the cell is their home."""

    def __init__(self, b: pa.RecordBatch, low: int, high: int, tables: int):
        part = b.slice(low, high - low)
        self.node, self.weight = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
        self.home, self.own = (part.column(k).to_numpy(zero_copy_only=False) for k in (6, 7))
        self.unit = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(high - low, -1)
        self.cells = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int64).reshape(high - low, tables, -1)


def _compare(cosine: float, tables: int):
    """Rows sorted by (cell, salt), homes of the salt first; yields (u, v, null) edges of forests and (u, null, links)."""

    def links(cell: int, h: list, g: _Members) -> Iterator[tuple]:
        node, unit, weight, cells = (np.concatenate([getattr(x, c)[x.own] for x in h]) for c in ("node", "unit", "weight", "cells"))
        for at in range(0, len(node), GUESTS):
            part = slice(at, at + GUESTS)
            i, j = np.nonzero(unit[part] @ g.unit.T >= cosine)
            i += at
            # two homes of a cell see each other from both sides
            keep = np.where(g.home[j], node[i] < g.node[j], node[i] != g.node[j])
            i, j = i[keep], j[keep]
            for k in range(0, len(i), PAIRS):
                x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                first = _first_meeting(cell, cells[x], g.cells[y])
                x, y = x[first], y[first]
                if len(x):
                    yield node[x], g.node[y], weight[x], g.weight[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for whole in batches:
            for low in range(0, whole.num_rows, GUESTS):
                b = whole.slice(low, GUESTS)
                keys = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)], 1)
                start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
                found = []
                for x, y in zip(start.tolist(), [*start[1:].tolist(), len(keys)]):
                    if key != tuple(keys[x]):
                        key, held = tuple(keys[x]), []
                    members = _Members(b, x, y, tables)
                    new, old = [members] if members.own.any() else [], held
                    if old or new:
                        found += links(key[0], old + new, members)
                    # homes that come in a later batch meet those before them as guests, in the order of their nodes
                    if old and new:
                        found += _back(links, key[0], members, old)
                    held = old + new
                if found:
                    a, v, wa, wv = (np.concatenate(c) for c in zip(*found))
                    ids, at = np.unique(np.concatenate([a, v]), return_inverse=True)
                    sums = np.zeros(len(ids), np.int64)
                    np.add.at(sums, at, np.concatenate([wv, wa]))
                    p, q = forest(a, v)
                    none = pa.nulls(len(ids), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), none, pa.array(sums)], names=["u", "v", "links"])
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.nulls(len(p), pa.int64())], names=["u", "v", "links"])

    return run


def _back(links, cell: int, new: _Members, old: list) -> Iterator[tuple]:
    """Links of the homes in ``new`` with homes held from earlier batches, which streamed past before these came."""
    for g in old:
        yield from links(cell, [new], g)


def vector_groups(
    vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, hot_homes: int = HOT_HOMES
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable
    over links; kept marks the row of that id.
    """
    rows = vectors.select(col(id_col).cast("bigint").alias("vec_id"), col(vec_col).cast("array<double>").alias("e")).mapInArrow(_units, "vec_id bigint, unit binary")
    rows = store(rows.select("vec_id", "unit", F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2")))
    different = rows.filter("unit is not null").groupBy("h1", "h2").agg(F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    different = store(different.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "unit", "weight", "low"))
    marked = store(different.select("node", "unit", "weight").mapInArrow(_marked(tables, blocks, probes, scale), "node bigint, unit binary, weight bigint, cells binary"))
    spread = marked.select("node", "cells").mapInArrow(_spread(tables, probes), "cell bigint, node bigint, home boolean")
    members = spread.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    salts = members.select("cell", F.ceil(F.col("homes") / hot_homes).cast("int").alias("salts"))
    live = spread.join(salts, "cell").select("cell", "node", "home", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    live = live.join(marked, "node").select("cell", "salt", "node", "unit", "weight", "cells", "home", (F.col("home") & (F.col("own") == F.col("salt"))).alias("own"))
    live = live.withColumn("salt", F.col("salt") * F.lit(1 << 32) + F.octet_length("unit"))  # whatever cells' hashes do, lengths stay apart
    dealt = live.repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("own"))
    found = store(dealt.mapInArrow(_compare(cosine, tables), "u bigint, v bigint, links bigint"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots_ = components(found.filter("v is not null").select("u", "v"))
    named = different.select("node", "h1", "h2", "weight", "low").join(counts, "node", "left").join(roots_, "node", "left")
    named = store(named.select("h1", "h2", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("links"), F.coalesce("root", "node").alias("root")))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"))
    names = store(named.join(least, F.col("root") == F.col("r")).select("h1", "h2", "links", "component_id", F.lit(True).alias("found")))
    for t in (different, marked, found, named):
        release(t)
    out = rows.select("vec_id", "h1", "h2", F.col("unit").isNotNull().alias("some")).join(names, ["h1", "h2"], "left")
    one = F.when(F.col("some"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("some"), F.col("links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"), one.alias("component_id"), F.col("vec_id").eqNullSafe(one).alias("kept"))
