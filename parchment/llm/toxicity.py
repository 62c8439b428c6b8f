"""Toxicity by a factorization machine over hashed terms.

    score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The terms of a text are its lower-cased words and their first 4, 5 and 6 characters, hashed
to 64 bits; x is their presence. The pairwise part, learnt through low-rank vectors, rates
terms that mean harm only together, which additive weights can't.

The model is fitted on the driver from at most ``max_toxic`` and ``max_clean`` labelled rows
(those with the smallest hash of their id; documented parameters, so the fit costs the same
at every corpus size), and the intercept is then set back to the class shares among all
labelled rows. Only terms whose presence depends on the label (chi-square of at least
``min_chi2``) get parameters, at most ``max_terms``; every other term of a text counts
nothing, so the model that is sent to the tasks has a fixed bound. Terms are counted by Spark
over the whole texts of the rows learnt from, and only those that get parameters reach the driver; of rows that
repeat an id ``max_rows_per_id`` are learnt from. Every document's whole text is scored.

Results for odd input: null and empty texts have no terms and score the intercept; without
labelled rows of both classes the score is the smoothed class share of all; labels of null
are no labels; a doc_id labelled twice counts as often as it is labelled; very long texts are
scored whole; ties between ids in the choice of rows are settled by the id; columns of any name
are kept, dots included, except that ``score`` replaces the column it is told to make; no
documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from parchment.llm.rows import col, numbered, restored
from parchment.llm.storage import release, store

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
RANK = 4
THRESHOLD = 0.7
#: Words whose terms a task remembers at most.
KNOWN_WORDS = 100_000
#: Terms that get parameters at most, and how much their presence must depend on the label.
MAX_TERMS, MIN_CHI2 = 20_000, 10.8


def word_terms(word: str) -> list[int]:
    return [xxh64_intdigest(word)] + [xxh64_intdigest(f"{word[:n]}\x00{n}") for n in PREFIXES if len(word) >= n]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """terms: sorted hashes; w and v: their weights and vectors; w0: intercept."""

    w0: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))

    def scorer(self):
        place = {int(t): k for k, t in enumerate(self.terms)}

        class Known(dict):
            def __missing__(self, word):
                found = tuple(place[t] for t in word_terms(word) if t in place)
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                self[word] = found
                return found

        known, v2 = Known(), (self.v**2).sum(axis=1)

        def score(text: str | None) -> float:
            at = sorted({k for w in text_words(text) for k in known[w]})
            z = self.w0
            if at:
                s = self.v[at].sum(axis=0)
                z += float(self.w[at].sum()) + 0.5 * float((s * s).sum() - v2[at].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def chi_square(df, df1, pos, n):
    """How much a term's presence (df rows, df1 of them of class 1) depends on the class (pos of n rows)."""
    expected = df * pos / n
    return (df1 - expected) ** 2 / expected + (df1 - expected) ** 2 / (df - expected)


def chosen(rows: list[tuple[np.ndarray, int]], max_terms: int, min_chi2: float) -> np.ndarray:
    """The terms that get parameters, from rows in memory."""
    y = np.array([label for _, label in rows], np.float64)
    terms, at = np.unique(np.concatenate([t for t, _ in rows]), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    df, df1 = np.bincount(at, minlength=len(terms)).astype(np.float64), np.bincount(at, weights=y[doc], minlength=len(terms))
    chi2 = np.where(df < 2, 0, chi_square(df, df1, y.sum(), len(y)))
    keep = np.flatnonzero(chi2 >= min_chi2)
    return terms[np.sort(keep[np.argsort(-chi2[keep], kind="stable")][:max_terms])]


def fit(rows: list[tuple[np.ndarray, int]], share: float | None = None, kept: np.ndarray | None = None, rank: int = RANK, epochs: int = 100, rate: float = 0.1, decay: float = 1e-5, max_terms: int = MAX_TERMS, min_chi2: float = MIN_CHI2, seed: int = 7) -> Model:
    """rows: (hashes of the terms, label 0 or 1). share: of class 1 where it differs from that of the rows. kept: the terms that get parameters, sorted."""
    y = np.array([label for _, label in rows], np.float64)
    n, pos = len(y), float(y.sum())
    share = (pos + 1) / (n + 2) if share is None else share
    odds = float(np.log(share / (1 - share)))
    if not pos or pos == n:
        return Model(odds)
    kept = chosen(rows, max_terms, min_chi2) if kept is None else kept
    every = np.concatenate([t for t, _ in rows])
    doc = np.repeat(np.arange(n), [len(t) for t, _ in rows])
    at = np.searchsorted(kept, every)
    inside = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == every) if len(kept) else np.zeros(len(every), bool)
    doc, at, m = doc[inside], at[inside], len(kept)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(m), rng.normal(0, 0.01, (m, rank)), float(np.log(pos / (n - pos)))
    gw, gv, g0 = np.full(m, 1e-6), np.full((m, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            ids = order[a : a + 256]
            lens = bounds[ids + 1] - bounds[ids]
            row = np.repeat(np.arange(len(ids)), lens)
            idx = at[np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in ids])] if lens.sum() else np.zeros(0, np.int64)
            vi = v[idx]
            s = np.zeros((len(ids), rank))
            np.add.at(s, row, vi)
            z = w0 + np.bincount(row, w[idx], len(ids)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(row, (vi * vi).sum(axis=1), len(ids)))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ids]) / len(ids)
            d0, dw = e.sum(), np.bincount(idx, e[row], m) + decay * w
            dv = np.zeros_like(v)
            np.add.at(dv, idx, e[row][:, None] * (s[row] - vi))
            dv += decay * v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            w0, w, v = w0 - rate * d0 / np.sqrt(g0), w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    w0 += odds - float(np.log(pos / (n - pos)))
    return Model(w0, kept, w.astype(np.float32), v.astype(np.float32))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(np.array([t for w in text_words(x) for t in word_terms(w)], np.uint64)).view(np.int64) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["label", "terms"])


def _only(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.intersect1d(t.values.to_numpy(zero_copy_only=False).view(np.uint64), kept, assume_unique=True).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["label", "terms"])

    return run


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_toxic: int = 2000, max_clean: int = 4000, max_rows_per_id: int = 8, max_terms: int = MAX_TERMS, min_chi2: float = MIN_CHI2, **kw) -> Model:
    """A model from the labelled documents. labels: (id_col, label_col), the rows to learn from and no others."""
    known = labels.filter(col(label_col).isin(0, 1)).select(col(id_col).alias("known_id"), col(label_col).cast("int").alias("label"))
    shares = dict(known.groupBy("label").count().collect())
    mixed = F.xxhash64(F.col("known_id"), F.lit(7))
    picked = known.filter("label = 1").orderBy(mixed, "known_id").limit(max_toxic).unionAll(known.filter("label = 0").orderBy(mixed, "known_id").limit(max_clean))
    texts = docs.select(col(id_col).alias("doc"), col(text_col).alias("t")).join(F.broadcast(picked), F.col("doc") == F.col("known_id"))
    # equal rows are as good as one to learn from; of rows that share an id but not a text the first few by hash
    own = Window.partitionBy("known_id", "label").orderBy(F.xxhash64("t"))
    texts = texts.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= max_rows_per_id)
    rows = store(texts.select("label", "t").mapInArrow(_terms, "label int, terms array<bigint>"))
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    kept = np.zeros(0, np.uint64)
    if 0 < pos < n:
        counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"), F.sum("label").cast("double").alias("df1")).filter("df > 1")
        best = counted.select("term", chi_square(F.col("df"), F.col("df1"), F.lit(float(pos)), F.lit(float(n))).alias("chi2")).filter(F.col("chi2") >= min_chi2)
        best = best.orderBy(F.desc("chi2"), "term").limit(max_terms).select("term").toArrow()
        kept = np.sort(best.column("term").to_numpy().view(np.uint64))
    few = rows.mapInArrow(_only(kept), "label int, terms array<bigint>").toArrow()
    data = [(t.values.to_numpy(zero_copy_only=False).view(np.uint64), y) for t, y in zip(few.column("terms"), few.column("label").to_pylist())]
    data.sort(key=lambda r: (r[1], len(r[0]), r[0].tobytes()))  # the same model whatever the order of arrival
    release(rows)
    return fit(data, (shares.get(1, 0) + 1) / (shares.get(1, 0) + shares.get(0, 0) + 2), kept, **kw)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in column ``out``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        f = sent.value.scorer()
        for t in parts:
            yield t.map(f).astype("float64")

    import pandas as pd

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(run, "double")(F.coalesce(col(text_col), F.lit(""))))


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, by a model that learnt from the other two thirds' labels."""
    model = train(docs, labels.filter(~held_out(id_col)), text_col=text_col, id_col=id_col, **kw)
    rows = score(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("t")), model, "t")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels.filter(~held_out(id_col)), text_col=text_col, id_col=id_col, **kw)
    rows, names = numbered(docs)
    return restored(score(rows, model, names[text_col], "toxicity").filter(F.col("toxicity") < threshold), names)
