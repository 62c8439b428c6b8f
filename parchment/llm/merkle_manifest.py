"""Merkle dataset manifest: a digest over all rows, with the authentication path of every row.

Rows are leaves, ordered within their group; every ``ARITY`` consecutive nodes (the last run may
be shorter, down to one) become the digest of the next level while a group has several. What
remains is the group's subroot; the subroots, ordered by group, give the root likewise. A
row's proof is its run's other digests, level by level up to the root.

Merkle traversal scheduling: leaves are cut into aligned blocks of ARITY ** LEVELS, so a block is
a whole subtree, gathered in one bounded row. Upwards, a treehash (one open run a level) reduces
each block to its node; the nodes are the leaves of the next round, until one a group is left:
two more rounds for 10^10 rows. Downwards, each block walks its leaves in order. For each level
it holds the run around the leaf and a treehash that takes one leaf a step from the run after
it, so that the next run is ready when the walk gets there. That is at most a few runs a level,
logarithmic in the block. The path from the block's node to the root is shared by the whole
block and is appended.

Scale: texts are hashed where they are read; from then on a row is two digests and an id. Places
come from one range partitioning by (group, id, digest), whose bounds cut through a group that
holds any share of the rows, and from running counts a (group, partition). The driver sees the
number of rounds and the root.

Results for odd input: a null field is written ``-``; null groups come first; null ids come
last; rows with the same id are ordered by digest, and equal rows have equal subtrees whatever
their order; very long texts are hashed whole by the JVM; columns other than those named are
not read, whatever their names; no rows give no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parchment.llm.rows import col
from parchment.llm.storage import release, store

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: Bytes of a digest as the lowercase hex text in which it is hashed.
HEX = 64


def H(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, fields)), "UTF-8"), 256)


class Treehash:
    """Leaves go in one by one; nodes of ``level`` come out as they are complete. One open run a level is held."""

    def __init__(self, level: int):
        self.level, self.open = level, [[] for _ in range(level)]

    def push(self, node: bytes) -> list[bytes]:
        for run in self.open:
            run.append(node)
            if len(run) < ARITY:
                return []
            node = H(b"".join(run))
            run.clear()
        return [node]

    def close(self) -> list[bytes]:
        """What is left at the end of the leaves: shorter runs are hashed as they are."""
        node = None
        for run in self.open:
            if node is not None:
                run.append(node)
            node = H(b"".join(run)) if run else None
            run.clear()
        return [] if node is None else [node]


def subtree(leaves: list[bytes], levels: int) -> bytes:
    tree = Treehash(levels)
    for x in leaves:
        if done := tree.push(x):
            return done[0]
    return tree.close()[0]


def height(n: int) -> int:
    """Levels from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Level:
    """The run around the walk's place at one level, and the treehash that prepares the run after it."""

    def __init__(self, level: int, leaves: list[bytes]):
        self.leaves, self.tree, self.span, self.at = leaves, Treehash(level), ARITY ** (level + 1), 0
        self.ahead: list[bytes] = []
        for _ in range(self.span):
            self.step()
        self.turn()

    def step(self) -> None:
        """Takes one leaf of the run being prepared."""
        if self.at < len(self.leaves):
            self.ahead += self.tree.push(self.leaves[self.at])
            self.at += 1
            if self.at == len(self.leaves):
                self.ahead += self.tree.close()

    def turn(self) -> None:
        self.run, self.ahead = b"".join(self.ahead), []


def walk(leaves: list[bytes], levels: int) -> Iterator[list[tuple[int, bytes]]]:
    """For each leaf in order: (place in the run, the run's digests) level by level."""
    every = [Level(k, leaves) for k in range(levels)]
    for i in range(len(leaves)):
        for k, level in enumerate(every):
            if i and i % level.span == 0:
                level.turn()
            level.step()
        yield [(i // ARITY**k % ARITY, level.run) for k, level in enumerate(every)]


def others(place: int, run: bytes) -> bytes:
    return run[: HEX * place] + run[HEX * (place + 1) :]


def packed_path(path: list[tuple[int, bytes]]) -> bytes:
    """A path as bytes: for each level its place, its number of others and the others."""
    return b"".join(bytes([p, len(run) // HEX - 1]) + others(p, run) for p, run in path)


def opened(path: bytes) -> list[tuple[int, bytes]]:
    """(place, others) of each level of a packed path."""
    out, at = [], 0
    while at < len(path):
        size = HEX * path[at + 1]
        out.append((path[at], path[at + 2 : at + 2 + size]))
        at += 2 + size
    return out


def fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and its (place, others) lead to."""
    for place, rest in path:
        node = H(rest[: HEX * place] + node + rest[HEX * place :])
    return node


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g, ...) with pos, the row's number in its group by ``order``, and total, the group's rows."""
    rest = [c for c in rows.columns if c != "g"]
    keys = [F.col("g"), *(F.col(c).asc_nulls_last() for c in order)]
    tied = rows.withColumn("r", F.monotonically_increasing_id())  # so that equal rows can be cut as well
    keys = [*keys, F.col("r")]
    ranged = store(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g", *rest, F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = ranged.groupBy("g", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = store(counts.select("g", "part", "first", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total")))
    return ranged.withColumn("part", part).join(counts, ["g", "part"]).select("g", *rest, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "total")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """nodes (g, pos, total, digest, carried) -> a row for each aligned block, its members in order."""
    size = F.lit(BLOCK)
    members = F.struct("pos", "digest", *carried)
    b = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(members)).alias("ms"))
    return store(b.select("g", "block", "total", size.alias("size"), F.col("ms.digest").alias("digests"), *(F.col(f"ms.{c}").alias(c) for c in carried)))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tops = [subtree([x.encode() for x in d], min(LEVELS, height(total))).decode() for total, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tops, pa.string())], names=["g", "pos", "total", "digest"])


def _climb(nodes: DataFrame, carried: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of each round, and (g, digest), the node that is left of each group. most: a group's nodes at most."""
    rounds, left = [_blocks(nodes, carried)], None
    while True:
        done = rounds[-1].select("g", "block", "total", "digests").mapInArrow(_tops, "g string, pos bigint, total bigint, digest string")
        most = -(-most // BLOCK)
        left = store(done.withColumn("total", F.ceil(F.col("total") / BLOCK).cast("bigint")))
        if most <= 1:
            return rounds, left.select("g", "digest")
        rounds.append(_blocks(left, []))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for g, block, total, digests, upper in zip(*(c.to_pylist() for c in b.columns)):
            leaves = [x.encode() for x in digests]
            paths = [packed_path(p) + (upper or b"") for p in walk(leaves, min(LEVELS, height(total)))]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(paths), pa.string()), pa.array(range(block * BLOCK, block * BLOCK + len(paths)), pa.int64()), pa.array(paths, pa.binary())], names=["g", "pos", "path"])


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the members of all rounds but the first: (g, pos, path). above: (g, path), that of a group's last node."""
    known = above.select("g", F.lit(0).cast("bigint").alias("block"), "path")
    for r in reversed(rounds[1:]):
        rows = r.select("g", "block", "total", "digests").join(known, ["g", "block"])
        known = store(rows.mapInArrow(_paths, "g string, pos bigint, path binary")).withColumnRenamed("pos", "block")
    return known


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (total, digests, ids, claims, subroot, path) -> a row for each leaf."""
    names = ["id", "leaf", "subroot", "proof_sha256", "folded_root"]
    for b in batches:
        for total, digests, ids, claims, subroot, upper in zip(*(c.to_pylist() for c in b.columns)):
            leaves, out = [x.encode() for x in digests], []
            shared = opened(upper or b"")
            rest = b"".join(o for _, o in shared)
            for x, i, claim, path in zip(leaves, ids, claims, walk(leaves, min(LEVELS, height(total)))):
                own = [(p, others(p, run)) for p, run in path]
                proof = sha256(b"".join([*(o for _, o in own), rest])).hexdigest()
                start = x if claim is None else claim.encode()
                out.append((i, x.decode(), subroot, proof, fold(start, own + shared).decode()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=names)


def manifest(docs: DataFrame, fields: list[str], group_col: str, id_col: str = "doc_id", claims: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs.

    fields: the columns that a leaf covers, in order. claims replaces columns by what somebody
    else says they hold, in the rows where ``where`` is true; folded_root is the root that the
    claimed leaf (else the row's own) leads to with the row's proof, and verified says whether
    it is the root.
    """
    own = leaf([col(c) for c in fields])
    claim = F.lit(None).cast("string")
    if claims:
        claim = F.when(F.lit(True) if where is None else where, leaf([claims.get(c, col(c)) for c in fields]))
    group = F.coalesce(F.concat(F.lit("1"), col(group_col).cast("string")), F.lit("0"))
    rows = store(docs.select(group.alias("g"), col(id_col).cast("bigint").alias("id"), own.alias("digest"), claim.alias("claim")))
    placed = _placed(rows, ["id", "digest"])
    most = rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    rounds, subroots = _climb(placed, ["id", "claim"], most)
    groups = store(_placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"]))
    top_rounds, top = _climb(groups, ["name"], groups.count())
    root = top.first()
    end = top.select("g", F.lit(b"").alias("path"))
    # the groups' own paths: down through the upper rounds, then through the blocks of subroots
    upper = _descend(top_rounds, end)
    first = top_rounds[0].join(upper, ["g", "block"]).select("g", "block", "total", "digests", "path")
    at_top = store(first.mapInArrow(_paths, "g string, pos bigint, path binary"))
    above = store(groups.join(at_top, ["g", "pos"]).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "path"))
    known = _descend(rounds, above.select("g", "path"))
    blocks = rounds[0].join(known, ["g", "block"]).join(above.select("g", "subroot"), "g")
    out = blocks.select("total", "digests", F.col("id").alias("ids"), F.col("claim").alias("claims"), "subroot", "path")
    proofs = out.mapInArrow(_proofs, "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    release(rows)
    whole = F.lit(root["digest"] if root else None).cast("string")
    return proofs.select("id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
