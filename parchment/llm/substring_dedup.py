"""Substring dedup over sliding spans of sentences.

A text is cut into sentences (after ``.``, ``!``, ``?`` or their full-width forms before
white space, and at line ends). Runs of at least ``min_sentences`` sentences with at least
``min_words`` words are what is looked for; of the quadratically many runs of a text those
are hashed that decide the result: the shortest that starts at each sentence and the shortest
that ends there. A run is repeated only if all runs within it are, and each of its sentences
is in a shortest run that lies within it, so the sentences removed are those that hashing
every run would remove. A sentence of ``alone_words`` or more is a span by itself too. Without
``covering`` only the shortest runs by their starts are hashed, which leaves tails of runs. Spans are hashed to 128 bits over their lower-cased words,
so that case and spacing don't hide a copy, and joined globally: of spans with one hash the
occurrence with the smallest (doc_id, place) is the first, and every sentence that any other
occurrence covers is removed, with the white space after it.

Shuffles carry hashes and numbers, never text, until the documents that lose sentences are
joined with the list of what they lose. The first occurrence of each hash is a map-side
minimum, so a passage that a third of the corpus holds is one row a task; occurrences that
go are found by an anti join on their own place, which no hot span shares, among the
occurrences whose hash repeats.

Results for odd input: null texts stay null, empty ones empty; null doc_ids come last in the
order of occurrences; rows that repeat doc_id and text share a fate; a text may end empty;
no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parchment.llm.rows import col, numbered, restored, with_made
from parchment.llm.storage import store

MIN_SENTENCES = 2
MIN_WORDS = 20
ALONE_WORDS = 30
#: A sentence with the white space that follows it.
SENTENCE = re.compile(r"[^\n]*?(?:[.!?。！？]+[\"'»)\]]*(?=\s)|(?=\n)|\Z)\s*", re.S)


def sentences(text: str) -> list[str]:
    """The pieces of a text; joined they are the text."""
    return [m for m in SENTENCE.findall(text) if m]


def spans(pieces: list[str], min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, alone_words: int = ALONE_WORDS, covering: bool = True) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, 16-byte hash) of the span that starts at each sentence, none where the text ends too soon; covering adds the runs of long sentences and those by their ends."""
    words = [p.lower().split() for p in pieces]
    sizes = [len(w) for w in words]
    joined = [" ".join(w) for w in words]
    out = []
    end, have = 0, 0
    for i, own in enumerate(sizes):
        if end < i:
            end, have = i, 0
        while end < len(sizes) and (have < min_words or end - i < min_sentences):
            have += sizes[end]
            end += 1
        if own >= alone_words:
            out.append((i, 1, joined[i]))
        if own and have >= min_words and end - i >= min_sentences and (covering or own < alone_words):
            out.append((i, end - i, " ".join(joined[i:end])))
        have -= own if end > i else 0
    if covering:
        seen = {(i, n) for i, n, _ in out}
        start, have = 0, 0
        for j, own in enumerate(sizes):
            have += own
            while j - start >= min_sentences and have - sizes[start] >= min_words:
                have -= sizes[start]
                start += 1
            n = j + 1 - start
            if own and have >= min_words and n >= min_sentences and (start, n) not in seen:
                out.append((start, n, " ".join(joined[start : j + 1])))
    return [(i, n, xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))) for i, n, t in out]


def _cut(params: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th, at, n, h = [], [], [], [], []
            for doc, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = spans(sentences(text), *params)
                ids += [doc] * len(found)
                th += [mark] * len(found)
                at += [x[0] for x in found]
                n += [x[1] for x in found]
                h += [x[2] for x in found]
            two = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2) if h else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])],
                names=["doc_id", "th", "at", "n", "h1", "h2"],
            )

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, alone_words: int = ALONE_WORDS, covering: bool = True) -> DataFrame:
    """(doc_id, th, at, n): every non-first occurrence of a repeated span; th is the hash of the text."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(col(text_col)).alias("th"), text.alias("t"))
    all_spans = store(rows.mapInArrow(_cut((min_sentences, min_words, alone_words, covering)), "doc_id bigint, th bigint, at int, n int, h1 bigint, h2 bigint"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at", "th")
    first = all_spans.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("first"))
    first = store(first.filter("c > 1").select("h1", "h2", "first.doc_id", "first.th", "first.at"))
    # several spans may start at one place, so the hash tells which of them is first there
    again = all_spans.join(first.select("h1", "h2"), ["h1", "h2"], "left_semi")
    k = first.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("at").alias("__at"))
    return again.join(k, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")) & (F.col("at") == F.col("__at")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left_anti").select("doc_id", "th", "at", "n")


def _without():
    def cut(text: pa.Array, at: pa.Array, n: pa.Array) -> list[pa.Array]:
        texts, total, removed = [], [], []
        for t, a, m in zip(text.to_pylist(), at.to_pylist(), n.to_pylist()):
            pieces = sentences(t) if t else []
            gone = {k for i, c in zip(a, m) for k in range(i, i + c)} if a else ()
            texts.append("".join(p for k, p in enumerate(pieces) if k not in gone).rstrip() if gone else t)
            total.append(len(pieces))
            removed.append(len(gone))
        return [pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]

    return cut


def dedup_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", counts: bool = False, **kw) -> DataFrame:
    """docs without the sentences that non-first repeated spans cover, all columns kept, whatever their names; counts adds n_sentences and n_removed, which replace columns of those names."""
    cut = store(repeated_spans(docs, text_col, id_col, **kw).groupBy(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_list("at").alias("g_at"), F.collect_list("n").alias("g_n")))
    rows, names = numbered(docs)
    text = F.col(names[text_col])
    j = rows.join(cut, F.col(names[id_col]).cast("bigint").eqNullSafe(F.col("g_id")) & (F.xxhash64(text) == F.col("g_th")), "left")
    made = [("g_text", "string"), ("g_sentences", "bigint"), ("g_removed", "bigint")]
    out = with_made(j, [text, F.col("g_at"), F.col("g_n")], made, _without)
    new = {text_col: F.col("g_text")}
    if counts:
        new |= {"n_sentences": F.col("g_sentences"), "n_removed": F.col("g_removed")}
    return restored(out, names, new)
