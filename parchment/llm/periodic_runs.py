"""Periodic run detection by an all-lag scan.

A run is a stretch of consecutive words in which words ``period`` apart are identical, its
period the smallest such, its length at least ``min_length`` words and ``min_exp`` periods,
and which no neighbouring word extends. A text's words become ids, and the array of ids is
compared with itself at each lag up to n / min_exp; stretches of agreement that are long
enough are the runs of that lag.

A stretch of lag q has at least (min_exp - 1) * q agreements in a row. Lags from B to 2B - 1
are therefore compared at every (B / 2)-th word first, all of them in one vectorised
comparison; only where enough of these agree in a row are all words between them compared. That
is exact, and costs n * log(n) in place of n * n. A stretch whose period isn't the smallest
(3 words repeated also agree at lags of 6 and 9) is reduced to its smallest, which divides the
lag as the stretch holds at least two lags; so it doesn't matter which task sees which lag.

Spark distributes (document, lag range) pairs: texts up to ``long_bytes`` have one range and
are done where they are read; longer ones are dealt out once for each ``OCTAVES`` powers of
two of lags, the runs found meet by document, and the words are dropped in a last pass over
the long texts. No group is larger than one document's runs.

Results for odd input: null, empty and word-less texts have no words, no runs and an empty
collapsed text; a null doc_id is kept and handed on as such; rows that repeat a doc_id or a text
are each given their own row; texts of any length are read whole; of runs that share start and
length one has the smaller period and it is the one that counts; columns other than the two named are
not read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parchment.llm.rows import col

MIN_EXP, MIN_LENGTH = 3, 24
#: Bytes of a text from which on its lags are dealt out to several tasks.
LONG_BYTES = 64 << 10
#: Powers of two of lags in one range.
OCTAVES = 4
#: Cells of one vectorised comparison.
CELLS = 1 << 21
#: Words of agreement from which on a stretch is looked up among the runs known before it is compared.
LARGE = 4096

RUN = "struct<start:bigint,length:bigint,period:bigint>"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word as the place of its first occurrence."""
    seen: dict[bytes, int] = {}
    return np.array(list(map(seen.setdefault, words, range(len(words)))), np.int32)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True in a flat array."""
    wide = np.zeros(len(flags) + 2, np.bool_)
    wide[1:-1] = flags
    turn = np.flatnonzero(wide[1:] ^ wide[:-1])
    return turn[::2], turn[1::2]


def smallest_period(ids: np.ndarray, start: int, lag: int) -> int:
    """Smallest period of a stretch that has period ``lag`` and holds it at least twice: it divides the lag."""
    period, left, prime = lag, lag, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        while left % prime == 0:
            left //= prime
            shorter = period // prime
            if np.array_equal(ids[start : start + lag], ids[start + shorter : start + shorter + lag]):
                period = shorter
        prime += 1
    return period


def find_runs(ids: np.ndarray, low: int = 1, high: int | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> set[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs that show at a lag from ``low`` to ``high`` - 1."""
    n = len(ids)
    high = min(n // min_exp + 1, high or n)
    found: set[tuple[int, int, int]] = set()
    large: list[tuple[int, int, int]] = []
    base = 1
    while base < high:
        first, last = max(base, low), min(2 * base, high)  # the lags of this octave that are asked for
        step = max(1, base // 2)
        least = max((min_exp - 1) * base, min_length - 2 * base + 1) // step
        marks = -(-n // step)
        wide = max(1, CELLS // marks)
        for lag in range(first, last, wide):
            lags = min(wide, last - lag)
            padded = np.full(marks * step + lag + lags, -1, np.int32)
            padded[:n] = ids
            size = padded.itemsize
            shifted = np.ndarray((lags, marks), np.int32, padded, lag * size, (size, step * size))  # row r: every step-th word from lag + r on
            agree = np.zeros((lags, marks + 1), np.bool_)
            np.equal(shifted, ids[::step][None, :], out=agree[:, :-1])
            a, b = stretches(agree.ravel())
            some = b - a >= least
            for x, y in zip(a[some].tolist(), b[some].tolist()):
                q, x = lag + x // (marks + 1), x % (marks + 1)
                lo, hi = max(0, (x - 1) * step + 1), min(n - q, (x + y % (marks + 1) - x) * step)
                if hi - lo >= LARGE and any(q % p == 0 and s <= x * step and (y % (marks + 1) - 1) * step + q < s + k for s, k, p in large):
                    continue
                if step == 1:
                    s, e = np.array([x]), np.array([y % (marks + 1)])
                else:
                    s, e = stretches(ids[lo:hi] == ids[lo + q : hi + q])
                    s, e = s + lo, e + lo
                fits = e - s >= max((min_exp - 1) * q, min_length - q)
                for i, j in zip(s[fits].tolist(), e[fits].tolist()):
                    run = (i, j - i + q, smallest_period(ids, i, q))
                    if run not in found:
                        found.add(run)
                        if run[1] >= LARGE:
                            large.append(run)
        base *= 2
    return found


def kept_words(words: list[bytes], runs: set[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first ``period`` ones."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, k, p in runs:
        edge[s + p] += 1
        edge[s + k] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _words(doc, text: bytes, rewrite: Rewrite | None) -> list[bytes]:
    words = text.split()  # for bytes: white space is 09-0D and 20
    return rewrite(doc, words) if rewrite else words


def _row(doc, words: list[bytes], runs: set) -> tuple:
    dicts = [{"start": s, "length": k, "period": p} for s, k, p in sorted(runs, key=lambda r: (r[0], r[2]))]
    return doc, len(words), dicts, b" ".join(kept_words(words, runs)).decode("utf-8", "replace")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    docs, n, runs, texts = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


ROW = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"


def _whole(min_exp: int, min_length: int, rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = _words(doc, text.as_py(), rewrite)
                out.append(_row(doc, words, find_runs(word_ids(words), 1, None, min_exp, min_length)))
            yield _rows(out)

    return run


def _range(min_exp: int, min_length: int, rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th, runs = b.column(0), b.column(1), []
            for d, text, low, high in zip(doc.to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                found = find_runs(word_ids(_words(d, text.as_py(), rewrite)), low, high, min_exp, min_length)
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in found])
            yield pa.RecordBatch.from_arrays([doc, th, pa.array(runs, RUNS)], names=["doc_id", "th", "runs"])

    return run


def _collapse(rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                out.append(_row(doc, _words(doc, text.as_py(), rewrite), {(r["start"], r["length"], r["period"]) for r in runs or ()}))
            yield _rows(out)

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, long_bytes: int = LONG_BYTES, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: runs (start, length, period) by start and period, numbered by word.

    collapsed joins by one space the words that no run contains after its first period.
    rewrite: changes the words of a document before they are looked at.
    """
    if min_exp < 2:
        raise ValueError("a run holds its period twice at least")
    text = F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), text.alias("t"))
    size = F.octet_length("t")
    short = rows.filter(size <= long_bytes).mapInArrow(_whole(min_exp, min_length, rewrite), ROW)
    long = rows.filter(size > long_bytes).select("doc_id", F.xxhash64("t").alias("th"), "t")
    # a text of k bytes has at most (k + 1) / 2 words, so lags below its size over 2 * min_exp
    most = F.ceil(F.log2(size / (2 * min_exp) + 2)).cast("int")
    first = F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0)), F.lit(OCTAVES))
    dealt = long.select("doc_id", "th", "t", F.explode(first).alias("o")).select("doc_id", "th", "t", F.expr("shiftleft(1L, o)").alias("low"), F.expr(f"shiftleft(1L, o + {OCTAVES})").alias("high"))
    dealt = dealt.repartition("doc_id", "th", "low")
    parts = dealt.mapInArrow(_range(min_exp, min_length, rewrite), f"doc_id bigint, th bigint, runs array<{RUN}>")
    merged = parts.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("h")).agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    again = long.join(merged, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left").select("doc_id", "t", "runs")
    return short.unionAll(again.mapInArrow(_collapse(rewrite), ROW))
