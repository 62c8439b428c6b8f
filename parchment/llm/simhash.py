"""SimHash near-dedup by anchor-point covering.

Fingerprint: 64 bits by majority over the XXH64 hashes of a text's word shingles. Two
fingerprints link at ``max_distance`` (3) or fewer differing bits.

Search: linked fingerprints differ in at most one bit of one of their 32-bit halves. The
anchors of a half are the words of a covering code: the perfect Hamming code of length 31
(covering radius 1), times the remaining bit as it is. Every half lies within the radius of
exactly one anchor, its home, and is replicated to each anchor within covering radius plus
threshold, 2, that a word one bit away could have as home: 1 + 15 + 1 of them. Two halves
that differ in one bit therefore meet at the home of either, and a full comparison at the
anchor decides. 2^27 anchors a half keep the buckets small: about 34 rows a fingerprint, and
34 / 2^27 of all pairs are compared.

Skew: equal fingerprints are one row from the start, so exact copies cost nothing. Anchors
that are home to many different fingerprints are found by a count over the homes and split:
their homes are salted, their guests sent to every salt; all pairs still meet. In a task
homes are held, guests stream past, and links are reduced at once to a spanning forest,
so that a group of n near copies leaves a task as fewer than n edges. The edges
then go through distributed connected components.

Results for odd input: null and word-less texts have fingerprint zero and link like any
other; a null doc_id never names a component unless all its members have none; rows that
repeat a doc_id are each given their own row; texts are read whole, however long, a counter a bit
being all that is held; a bit set in exactly half the hashes is 0; columns other than the two
named are not read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from parchment.llm.components import components
from parchment.llm.rows import col
from parchment.llm.storage import release, store

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
#: Different fingerprints at one home from which on an anchor is split.
HOT_HOMES = 4096
#: Cells of a block of comparisons.
CELLS = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit j is 1 if it is set in over half of the hashes of the shingles, repeats included."""
    ws = text.lower().split()  # for bytes: A-Z only, and white space is 09-0D and 20
    if not ws:
        return 0
    if len(ws) <= shingle:
        grams = [b" ".join(ws)]
    else:
        grams = map(b" ".join, zip(*(ws[k:] for k in range(shingle))))
    h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT), a row for each row of docs."""
    text = F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")
    return docs.select(col(id_col).cast("bigint").alias("doc_id"), text.alias("t")).mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the bits set in the low 31 bits: 0 on words of the Hamming code."""
    s = np.zeros(v.shape, np.int64)
    for place in range(1, 32):
        s ^= ((v >> (place - 1)) & 1) * place
    return s


def _flip(v: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.where(place > 0, v ^ (1 << np.maximum(place - 1, 0)), v)


def homes(fp: np.ndarray) -> np.ndarray:
    """(n, 2) keys: for each half its number in bit 32 and the nearest anchor below."""
    u = fp.view(np.uint64)
    out = []
    for half in (0, 1):
        x = ((u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        v = x & 0x7FFFFFFF
        out.append(half << 32 | (x & 0x80000000) | _flip(v, _syndrome(v)))
    return np.stack(out, 1)


def guests(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the anchors within covering radius plus one of each half, other than its home."""
    u = fp.view(np.uint64)
    rows, keys = [], []
    for half in (0, 1):
        x = ((u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        v, top = x & 0x7FFFFFFF, x & 0x80000000
        s = _syndrome(v)
        every = np.arange(len(fp))
        rows.append(every)
        keys.append(half << 32 | (top ^ 0x80000000) | _flip(v, s))
        for i in range(1, 32):  # two flips i and j with i xor j = s lead to a word of the code at distance 2
            j = s ^ i
            at = every[(s > 0) & (j > i)]
            rows.append(at)
            keys.append(half << 32 | top[at] | _flip(_flip(v[at], np.full(len(at), i)), j[at]))
    return np.concatenate(rows), np.concatenate(keys)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        own = homes(fp)
        rows, keys = guests(fp)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([own[:, 0], own[:, 1], keys])), pa.array(np.concatenate([fp, fp, fp[rows]])), pa.array(np.arange(2 * len(fp) + len(rows)) < 2 * len(fp))],
            names=["anchor", "fp", "home"],
        )


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(homes(b.column(0).to_numpy(zero_copy_only=False)).ravel())], names=["anchor"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b reduced to stars: (vertex, smallest vertex of its component), fewer rows than vertices."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def compare(most: int, words: int):
    """Rows (anchor, salt, node, fp, home) sorted by anchor and salt, homes first; yields stars (u, v) of links between nodes.

    fp: ``words`` times 64 bits, as a number if it is one word, else as bytes. Homes are held, guests stream past
    them batch by batch, so that memory follows the homes of an anchor, which are split, and not its guests.
    """

    def links(hn, hf, gn, gf):
        wide = max(1, CELLS // max(1, len(gn) * words))
        for at in range(0, len(hn), wide):
            apart = np.zeros((len(hn[at : at + wide]), len(gn)), np.uint16)
            for w in range(words):
                apart += np.bitwise_count(hf[at : at + wide, None, w] ^ gf[None, :, w])
            i, j = np.nonzero(apart <= most)
            a, b = hn[at : at + wide][i], gn[j]
            off = a != b
            yield forest(a[off], b[off])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hn, hf = None, np.zeros(0, np.int64), np.zeros((0, words), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            node, home = b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            fps = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(-1, words) if pa.types.is_binary(b.column(3).type) else b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
            start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            end = np.r_[start[1:], len(keys)]
            n_home = np.add.reduceat(home.astype(np.int64), start)
            goes_on = key is not None and tuple(keys[0]) == key
            alone = n_home == 1  # the usual anchor: one home, some guests, all such anchors at once
            alone[0] &= not goes_on
            g = np.repeat(np.arange(len(start)), end - start)
            at = np.flatnonzero(alone[g] & ~home)
            first = start[g[at]]
            apart = np.bitwise_count(fps[first] ^ fps[at]).sum(axis=1, dtype=np.int64)
            near = (apart <= most) & (node[first] != node[at])
            a, v = [node[first[near]]], [node[at[near]]]
            for k in np.flatnonzero((n_home > 1) | ((np.arange(len(start)) == 0) & goes_on)):
                x, y = start[k], end[k]
                old = k == 0 and goes_on
                new = home[x:y]
                ns, fs = (np.concatenate([hn, node[x:y][new]]), np.concatenate([hf, fps[x:y][new]])) if old else (node[x:y][new], fps[x:y][new])
                for p, q in links(ns, fs, node[x:y], fps[x:y]):
                    a.append(p), v.append(q)
            x = start[-1]
            again = len(start) == 1 and goes_on
            new = home[x:]
            hn, hf = (np.concatenate([hn, node[x:][new]]), np.concatenate([hf, fps[x:][new]])) if again else (node[x:][new].copy(), fps[x:][new].copy())
            key = tuple(keys[-1])
            p, q = forest(np.concatenate(a), np.concatenate(v))
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["u", "v"])

    return run


def dealt(spread: DataFrame, own: DataFrame, carried: list[str], vertex: str, hot_homes: int) -> DataFrame:
    """spread (anchor, carried, home) dealt by anchor and salt and sorted, homes first. own: the anchors of all homes.

    An anchor with more than hot_homes homes has them salted, its guests, and its other homes as guests, go to
    every salt. Such anchors are few, one for hot_homes rows at most; all others go their way without a join of
    their counts.
    """
    counts = store(own.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot_homes).select(F.col("anchor").alias("hot"), F.ceil(F.col("n") / hot_homes).cast("int").alias("salts")))
    if counts.isEmpty():
        split = spread.select("anchor", F.lit(0).alias("salt"), *carried, "home")
    else:
        salts = F.coalesce("salts", F.lit(1))
        mine = F.pmod(F.xxhash64(vertex), salts).cast("int").alias("own")
        split = spread.join(counts, F.col("anchor") == F.col("hot"), "left").select("anchor", *carried, "home", mine, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        split = split.select("anchor", "salt", *carried, (F.col("home") & (F.col("own") == F.col("salt"))).alias("home"))
    return split.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))


def link(fps: DataFrame, max_distance: int = MAX_DISTANCE, hot_homes: int = HOT_HOMES) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v): edges that connect what links of max_distance or less connect."""
    if not 0 <= max_distance <= 3:
        raise ValueError("the two halves leave one differing bit to a half for distances of 3 or less")
    spread = fps.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint, home boolean")
    own = fps.select("fp").mapInArrow(_homes, "anchor bigint")
    rows = dealt(spread, own, ["fp"], "fp", hot_homes).select("anchor", "salt", F.col("fp").alias("node"), "fp", "home")
    return rows.mapInArrow(compare(max_distance, 1), "u bigint, v bigint")


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links."""
    marks = store(fingerprints(docs, text_col, id_col, shingle))
    fps = store(marks.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = store(link(fps, max_distance))
    roots = components(edges)
    release(edges)
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = store(named)
    low = store(named.groupBy("root").agg(F.min("low").alias("component_id")))
    names = store(named.join(low, "root").select("fp", "component_id"))
    for table in (fps, named, low):
        release(table)
    return marks.join(names, "fp").select("doc_id", "fp", "component_id")
