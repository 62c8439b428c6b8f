"""Exact dedup: Patricia tries own the texts of each (length, content hash) partition.

Two passes of the same trie. First each input task inserts the whole normalised texts that
it reads; equal ones meet at one terminal node, and only the first row of a terminal carries
the text on, so a group of copies that holds a third of the corpus leaves each task as one
text. Then those texts are dealt out by (length, content hash) and inserted again, full byte
strings once more, and each terminal node stores the smallest identifier, the count and the
best row of all that arrived. Rows follow their task's terminal, never their group, so no
task receives a whole group's rows.

Spill by subtree: rows reach the second trie sorted by (length, hash), the first bytes of
its keys, so a subtree is complete as soon as the next one begins; it is then emitted and
let go, and what does not fit in memory waits in Spark's sorter, which spills. The first
pass lets its whole trie go after ``chunk_bytes`` of text, so a task's memory is bounded.

Results for odd input: null text counts as empty, and empty texts are equal; a null doc_id
sorts last and stays only if its group has no other; rows that share doc_id and text share
a fate; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parchment.llm.rows import col, one_of_each
from parchment.llm.storage import batch_rows, store

SPACE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 24 << 20
#: Rows of an Arrow batch, which holds whole texts on both sides of the pipe.
BATCH_ROWS = 1000

LOCAL = "doc_id bigint, part bigint, n bigint, h bigint, sha string, norm binary, best_cp bigint, best_id bigint, cnt bigint"
OWNED = "part bigint, keep_id bigint, group_size bigint"


class Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value = label, {}, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: each step compares memory, not characters."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A radix trie over byte strings; inserting returns the terminal node, shared by equal strings."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes) -> Node:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _common(label, key[at : at + len(label)])
            upper = Node(label[:k])
            child.label = label[k:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + k
        return node


def _before(a: tuple, b: tuple) -> bool:
    """Whether row (code points, id) a stays rather than b: more code points, then the smaller id, null last."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _local(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    seq = TaskContext.get().partitionId() << 33
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("best_cp", pa.int64()), ("best_id", pa.int64()), ("cnt", pa.int64())])
    trie, held, rows = PatriciaTrie(), 0, []

    def flush() -> pa.RecordBatch:
        done, out = set(), []
        for doc, node in rows:
            part, n, h, sha, norm, best, cnt = node.value
            if part in done:
                out.append((doc, part, n, h, sha, None, None, None, None))
            else:
                done.add(part)
                out.append((doc, part, n, h, sha, norm, best[0], best[1], cnt))
        cols = list(zip(*out)) if out else [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    for b in batches:
        for doc, cp, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            norm = text.translate(None, SPACE)
            h = xxhash.xxh64_intdigest(norm)
            node = trie.insert(len(norm).to_bytes(8, "big") + h.to_bytes(8, "big") + norm)
            if node.value is None:
                node.value = [seq, len(norm), h - (1 << 64) if h >> 63 else h, hashlib.sha256(norm).hexdigest(), norm, (cp, doc), 1]
                seq += 1
                held += 2 * len(norm) + 400
            else:
                node.value[6] += 1
                if _before((cp, doc), node.value[5]):
                    node.value[5] = (cp, doc)
            rows.append((doc, node))
            if held > chunk_bytes or len(rows) > 200_000:
                yield flush()
                trie, held, rows = PatriciaTrie(), 0, []
    yield flush()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    out: list = []
    trie, parts, last = PatriciaTrie(), [], None

    def close() -> None:
        out.extend((p, node.value[0][1], node.value[1]) for p, node in parts)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    for b in batches:
        for part, n, h, norm, cp, doc, cnt in zip(*(c.to_pylist() for c in b.columns)):
            if (n, h) != last:  # the subtree is complete
                close()
                trie, parts, last = PatriciaTrie(), [], (n, h)
            node = trie.insert(norm)
            if node.value is None:
                node.value = [(cp, doc), cnt]
            else:
                node.value[1] += cnt
                if _before((cp, doc), node.value[0]):
                    node.value[0] = (cp, doc)
            parts.append((part, node))
        if len(out) > 20_000:
            yield batch()
            out.clear()
    close()
    yield batch()


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row: texts are equal without their ASCII white space."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("cp"), F.encode(text, "UTF-8").alias("t"))
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        local = store(rows.mapInArrow(_local, LOCAL))
        texts = local.filter("norm is not null").select("part", "n", "h", "norm", "best_cp", "best_id", "cnt")
        owned = store(texts.repartition("n", "h").sortWithinPartitions("n", "h").mapInArrow(_own, OWNED))
    out = local.select("doc_id", "part", "sha").join(owned, "part")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of equal texts one row, with all its columns: that with the most code points, then the smallest id.

    Rows go by id and text, so that a text that only shares its id with a copy stays; of rows
    that share both, one stays. A null id comes last.
    """
    groups = store(exact_groups(docs, text_col, id_col).groupBy("doc_id", F.col("text_sha256").alias("sha"), "kept").agg(F.count("*").alias("c")))
    raw = F.coalesce(col(text_col), F.lit(""))
    sha = F.sha2(F.encode(F.translate(raw, SPACE.decode(), ""), "UTF-8"), 256)
    gone, twice = groups.filter("not kept").select("doc_id", "sha"), groups.filter("kept and c > 1").select("doc_id", "sha")
    return one_of_each(docs, [col(id_col).cast("bigint"), sha], gone, twice, [-F.length(raw)])
