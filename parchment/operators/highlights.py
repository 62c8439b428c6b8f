"""Where active keywords stand in the items of their documents.

A document's keywords make one automaton (Aho-Corasick), which finds all of them in one pass over an item, however many
there are. A single word must be a whole token of the item; several words must stand between ASCII word borders, and
occurrences of one keyword don't overlap. Case doesn't count. Places are half-open, within the item.
A hundred pages at a time are Python objects, without their tokens' texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parchment.operators.search import with_tokens
from parchment.operators.term_counts import parts
from parchment.sources.tables import pages

WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        if t:
            found.add_word(t, t)
    found.make_automaton()
    return found


def border(text: str, at: int) -> bool:
    """Whether an ASCII word begins or ends there."""
    return (at > 0 and text[at - 1] in WORD) != (at < len(text) and text[at] in WORD)


def spans(text: str, whole: set[tuple[int, int]], found) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) in one pass. whole: the places of the text's tokens."""
    behind: dict[str, int] = {}
    for last, term in found.iter(lowered(text)):
        start, end = last + 1 - len(term), last + 1
        if " " not in term:
            if (start, end) in whole:
                yield start, end, term
        elif border(text, start) and border(text, end) and start >= behind.get(term, 0):
            behind[term] = end
            yield start, end, term


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: tuple = ((), None)
    for b in parts(batches, 100):
        out = []
        for doc, page, items, starts, ends, terms in zip(*(c.to_pylist() for c in b.columns)):
            key = tuple(terms)
            if key != made[0]:
                made = (key, automaton(key) if any(key) else None)
            if made[1] is None:
                continue
            for item in items:
                first = item["start"]
                lo, hi = bisect_left(starts, first), bisect_left(starts, item["end"])
                whole = {(s - first, e - first) for s, e in zip(starts[lo:hi], ends[lo:hi])}
                out += [(doc, page, item["item_index"], *s) for s in spans(item["text"], whole, made[1])]
        cols = list(zip(*out)) if out else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "page", "item_index", "start", "end", "term"])


def keyword_spans(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(doc_id, page, item_index, start, end, term). docs: documents or stored pages; active: (doc_id, term), a document's active keywords.

    Terms are lower-cased, and repeated ones count once. Documents without active keywords have no rows.
    """
    terms = active.filter("term is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.lower("term"))).alias("terms"))
    rows = with_tokens(pages(docs)).select("doc_id", "page", "items", F.col("toks.start").alias("starts"), F.col("toks.end").alias("ends")).join(terms, "doc_id")
    return rows.select("doc_id", "page", "items", "starts", "ends", "terms").mapInArrow(_run, "doc_id bigint, page int, item_index int, start int, end int, term string")
