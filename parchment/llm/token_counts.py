"""Token counts by prefix dynamic programming, for a sentencepiece BPE vocabulary.

No piece of such a vocabulary has a space mark after another character, so no merge crosses
the start of a run of spaces: a text is a sequence of units, each a run of spaces and what
follows it, and the count of a prefix is that of the units before its last one plus that of
the last, cut, unit:

    count(prefix) = count(prefix without its last unit) + count(last unit)

The recurrence is exact, ``check_vocabulary`` refuses a vocabulary for which it isn't. The
table over unit ends is stored a document (``prefix_counts``); the entries between two unit
ends come from the same recurrence on the prefixes of one unit, so truncation and budget
questions need no second encoding of the text. Counts of units are remembered by each task,
up to ``MEMO`` of them.

Counts are those of the library without begin, end or added special tokens; the strings of
special tokens inside a text are ordinary text, as is the library's default. Null and empty
texts count 0. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECES = "piece_bpe_32k.model"
LIMIT = 4096
MEMO = 400_000
MARK = "▁"
UNIT = re.compile(r" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


class PrefixCounter(dict):
    """unit -> its number of tokens; a unit starts with at least one space."""

    _open: dict = {}

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=str(model))
        check_vocabulary(self.sp)

    @classmethod
    def of(cls, model: str) -> PrefixCounter:
        if model not in cls._open:
            cls._open[model] = cls(model)
        return cls._open[model]

    def __missing__(self, unit: str) -> int:
        # the library puts one space mark before a text: the unit's own first space
        n = len(self.sp.encode(unit[1:])) if len(unit) > 1 else 1
        if len(self) >= MEMO:
            self.clear()
        if len(unit) <= 64:
            self[unit] = n
        return n

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text.replace(MARK, " ")) if text else []

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): code points and tokens up to the end of each unit."""
        u = self.units(text)
        ends = np.fromiter(map(len, u), np.int64, len(u)).cumsum() - (1 if u else 0)
        return ends, np.fromiter(map(self.__getitem__, u), np.int64, len(u)).cumsum()

    def every(self, text: str) -> np.ndarray:
        """Token count of each prefix: entry i is that of the first i code points."""
        out, done = [0], 0
        for u in self.units(text):
            first = 1 if len(out) > 1 else 2  # the first unit's space isn't in the text
            out.extend(done + self[u[:k]] for k in range(first, len(u) + 1))
            done += self[u]
        return np.array(out, np.int64)

    def longest(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens, from the table and the units that may hold its end."""
        ends, counts = self.table(text)
        units = self.units(text)
        k = int(np.searchsorted(counts, budget, "right"))
        best = int(ends[k - 1]) if k else 0
        if k < len(units):
            start, done, u = best, int(counts[k - 1]) if k else 0, units[k]
            for j in range(2 if k == 0 else 1, len(u)):
                if done + self[u[:j]] <= budget:
                    best = start + j - (1 if k == 0 else 0)
        return best


def check_vocabulary(sp) -> None:
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if MARK in piece.lstrip(MARK) and not (sp.is_control(i) or sp.is_unknown(i)):
            raise ValueError(f"piece {i} has a space mark inside; units would not be independent")


def _run(model: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(model)
        for b in batches:
            tables = [counter.table(t) for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([int(c[-1]) if len(c) else 0 for _, c in tables], pa.int64())]
            if full:
                cols += [pa.array([e for e, _ in tables], pa.list_(pa.int64())), pa.array([c for _, c in tables], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "ends", "counts"][: len(cols)])

    return run


def prefix_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str | None = None, tables: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens[, ends, counts]) for each row; the stored table answers any prefix question.

    ``ends`` and ``counts`` are the table over unit ends: for a budget, the last entry of
    ``counts`` that does not exceed it gives the longest prefix of whole units.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("t"))
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint" + ", ends array<bigint>, counts array<bigint>" * tables
    return rows.mapInArrow(_run(model or default_model(), tables), schema)


def truncate(docs: DataFrame, budget: int = LIMIT, text_col: str = "text", model: str | None = None) -> DataFrame:
    """docs with each text cut to its longest prefix of at most ``budget`` tokens; null stays null."""
    model = model or default_model()

    @F.pandas_udf("bigint")
    def longest(t):
        counter = PrefixCounter.of(model)
        return t.map(lambda x: counter.longest(x, budget) if x else 0).astype("int64")

    longest.__annotations__ = {}
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.substring(F.col(text_col), F.lit(1), longest(F.coalesce(F.col(text_col), F.lit(""))))))


def over_budget(docs: DataFrame, limit: int = LIMIT, **kw) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit)."""
    return prefix_counts(docs, tables=False, **kw).withColumn("over_limit", F.col("n_tokens") > limit)
