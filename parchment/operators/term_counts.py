"""Counts within documents: terms, pairs and n-grams of a batch of documents at a time, as sorted integers.

Each function takes Arrow batches of (doc_id, ts, ..), ts being a document's terms in order, and is run by ``mapInArrow``.
A document lies within one batch, so nothing is summed further; batches are taken in parts, and memory follows the part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

COUNTED = "array<struct<term:string,tf:bigint,df:bigint,page:int,i:int>>"
GRAMS = "array<struct<less:double,k:int,n:int,g:string,frequency:bigint>>"
RANKS = "array<struct<term:string,raw:double,n:bigint,frequency:bigint>>"
#: Rows of a batch that are worked on at once: what numpy holds follows them, not the batch.
PART = 500


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The number of its document for each entry, and the entries."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def _coded(terms: pa.Array) -> tuple[np.ndarray, pa.Array, int]:
    """Terms as numbers, the different terms, and one more than the greatest number."""
    d = terms.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary, len(d.dictionary) + 1


def _listed(doc: np.ndarray, size: int, /, **fields: pa.Array | np.ndarray) -> pa.ListArray:
    """For each of so many documents the list of its entries; doc ascends."""
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=size))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], names=list(fields)))


def _with(batch: pa.RecordBatch, lists: pa.ListArray) -> pa.RecordBatch:
    """The batch with lists in place of ts."""
    return pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=batch.schema.names)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ts of (term, page, i), ..) -> the same with COUNTED: how often a term occurs, on how many pages, and where first."""
    for b in parts(batches):
        doc, ts = _flat(b.column(1))
        code, terms, v = _coded(ts.field("term"))
        page, i = (ts.field(c).to_numpy().astype(np.int64) for c in ("page", "i"))
        key, first, own, tf = np.unique(doc * v + code, return_index=True, return_inverse=True, return_counts=True)
        most = int(page.max(initial=0)) + 1
        df = np.bincount(np.unique(own * most + page) // most, minlength=len(key))
        yield _with(b, _listed(doc[first], b.num_rows, term=terms.take(pa.array(code[first])), tf=tf.astype(np.int64), df=df.astype(np.int64), page=page[first].astype(np.int32), i=i[first].astype(np.int32)))


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ts of terms, ..) -> the same with GRAMS: uni-, bi- and trigrams that occur twice or more; less is the score, negative.

    A gram occurs twice only if what it begins and ends with does, so the others aren't looked at.
    """
    for b in parts(batches):
        doc, ts = _flat(b.column(1))
        code, terms, v = _coded(ts)
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        begin, own, twice, found = np.arange(len(doc)), doc, np.ones(len(doc), bool), []
        for k in (1, 2, 3):
            # own: the number of the gram of k - 1 words that begins at begin, both of whose parts occur twice
            _, first, inv, n = np.unique(own * v + code[begin + k - 1], return_index=True, return_inverse=True, return_counts=True)
            first, many = begin[first], n >= 2
            found.append((first[many], n[many], k))
            twice = np.zeros(len(doc) + 1, bool)
            twice[begin] = many[inv]
            number = np.zeros(len(doc), np.int64)
            number[begin] = inv
            begin = np.flatnonzero(twice[:-1] & twice[1:])
            begin = begin[begin + k < len(doc)]
            begin = begin[doc[begin] == doc[begin + k]]
            own = number[begin]
        first, n, k = (np.concatenate([np.full(len(f[0]), f[2]) if c == 2 else f[c] for f in found]).astype(np.int64) for c in range(3))
        words = [terms.take(pa.array(np.where(k > j, code[np.minimum(first + j, len(code) - 1)], -1), pa.int64(), mask=k <= j)) for j in range(3)] if len(first) else [pa.array([], pa.string())] * 3
        text = pc.binary_join_element_wise(*words, " ", null_handling="skip")
        order = np.argsort(doc[first], kind="stable")
        less = -(n * np.array([0, 1.0, 1.5, 2.0])[k])
        yield _with(b, _listed(doc[first][order], b.num_rows, less=less[order], k=k[order].astype(np.int32), n=place[first][order].astype(np.int32), g=text.take(pa.array(order)), frequency=n[order]))


def pairs(reach: int):
    """(doc_id, ts of terms) -> (doc_id, a, b, w), a < b: how often two different terms are at most ``reach`` places apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, ts = _flat(b.column(1))
            code, terms, v = _coded(ts)
            rank = np.argsort(np.argsort(np.array([t.encode() for t in terms.to_pylist()], object)))  # codes in the order of the terms' bytes
            terms, code = terms.take(pc.array_sort_indices(pa.array(rank))), rank[code] if len(rank) else code
            # a batch is taken in parts, as there are reach times as many pairs as places
            edges = np.searchsorted(doc, np.arange(0, b.num_rows + 256, 256))
            for lo, hi in zip(edges[:-1], edges[1:]):
                d, c, out = doc[lo:hi], code[lo:hi], []
                for k in range(1, reach + 1):
                    x, y = c[:-k], c[k:]
                    fits = (d[:-k] == d[k:]) & (x != y)
                    out.append((d[k:][fits] - (d[0] if len(d) else 0)) * (v * v) + np.minimum(x, y)[fits] * v + np.maximum(x, y)[fits])
                key, w = np.unique(np.concatenate(out), return_counts=True)
                at = key // (v * v) + (d[0] if len(d) else 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), terms.take(pa.array(key // v % v)), terms.take(pa.array(key % v)), pa.array(w.astype(np.int64))], names=["doc_id", "a", "b", "w"])

    return run


def several(counts: dict):
    """(doc_id, ts of (term, page, i), n_pages, n_tokens) -> doc_id, n_pages, n_tokens and a list for each of the counts: functions
    of batches (doc_id, ts) or, where ``terms`` is their value's second part, of (doc_id, ts of terms) that keep rows and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ts = b.column(1)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(ts).to_numpy(zero_copy_only=False))])
            words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), ts.flatten().field("term"))
            given = {own: pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "ts"]) for own, x in (("all", ts), ("terms", words))}
            lists = [next(iter(f(iter([given[own]])))).column(1) for f, own in counts.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *lists], names=["doc_id", "n_pages", "n_tokens", *counts])

    return run
