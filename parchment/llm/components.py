"""Connected components over edges between 64-bit vertices, DataFrame operations only.

Rounds of large-star and small-star (each vertex hands its larger, then its smaller,
neighbours to the smallest vertex that it knows) until the edges are stars around the
smallest vertex of each component. The minima are written before they are joined, so that
both sides of the join come from an exchange and a vertex with very many edges is split by
adaptive execution. A round's edges are written to the shared folder, which keeps lineage
short and lets a lost executor cost one round's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parchment.llm.storage import release, store


def _minima(pairs: DataFrame) -> DataFrame:
    return store(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both)
    moved = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _settled(moved, low)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down)
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _settled(moved.unionAll(low.select("u", F.col("m").alias("v"))), low)


def _settled(moved: DataFrame, low: DataFrame) -> DataFrame:
    out = store(moved.filter("u <> v").distinct())
    release(low)
    return out


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) BIGINT pairs -> (node, root): each vertex that has an edge, with the smallest vertex reachable.

    Nulls and loops are left out; repeated and reversed pairs are fine; no rows give no rows.
    """
    e = store(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(e)
    while seen[0]:
        big = _large_star(e)
        new = _small_star(big)
        release(big)
        release(e)
        e, last, seen = new, seen, _digest(new)
        if seen == last:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
