"""Where the tokens of pages are what terms ask for: all tiers of all terms, over batches of pages.

What a token is to the terms follows from the token alone, so each different token of a batch is judged once and the pages' tokens
are looked up as numbers. Memory follows the batch, and what is remembered of tokens has a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from parchment.functions import fold as folding
from parchment.functions.text import TOKEN
from parchment.operators.term_counts import PART, _coded, _flat, _listed

HITS = "array<struct<term_ord:int,tier:int,many:boolean,fall:boolean,s:int,e:int>>"
REMEMBERED = 200_000


def stem(k: str) -> str:
    """``folding.stem`` of one key."""
    if not re.fullmatch("[a-z]+", k):
        return k
    n = len(k)
    if k.endswith("ies") and n >= 5:
        return k[:-3] + "y"
    if k.endswith("es") and n >= 5:
        return k[:-2] if re.search("(s|x|z|ch|sh)$", k[:-2]) else k[:-1]
    if k.endswith("s") and not k.endswith("ss") and n >= 4:
        return k[:-1]
    if k.endswith("ing") and n >= 6:
        return k[:-3]
    return k[:-2] if k.endswith("ed") and n >= 5 else k


def near(a: str, b: str, most: int) -> bool:
    """Whether two different keys are within an edit distance."""
    if a == b or abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    import unicodedata

    return np.fromiter((unicodedata.category(chr(n))[0] in "LN" for n in range(0x110000)), bool, 0x110000)


def letter_places(text: str, needles: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(ord, s, e) of all, also overlapping, occurrences of the needles in the text without anything but letters and digits."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(_letters()[codes])
    bare, out = codes[at].tobytes().decode("utf-32-le"), []
    for ord_, needle in needles:
        p = bare.find(needle)
        while p >= 0:
            out.append((ord_, int(at[p]), int(at[p + len(needle) - 1]) + 1))
            p = bare.find(needle, p + 1)
    return out


def hits(wanted: list[tuple[int, int, list[str], bool]], falls: list[tuple[int, str]] = (), low: bool = True):
    """A function of columns (doc_id, concat, tokens) -> HITS.

    wanted: (term_ord, tier, keys, many): runs of tokens whose keys at that tier are these; tier 3 are tokens near the one key.
    falls: (term_ord, needle): places of the fallback, tier 0; they are left out where a page of the document in the same batch
    has the term exactly, and the caller leaves out the others. tokens are strings, or structs with their places.
    """
    tests: dict[tuple[int, str], int] = {}
    plan = [(ord_, tier, [tests.setdefault((tier, k), len(tests)) for k in keys], many) for ord_, tier, keys, many in wanted]
    close = [(k, 1 if len(k) <= 7 else 2, n) for (tier, k), n in tests.items() if tier == 3]
    falls = [(n, q) for n, q in falls if q]

    def judge(token: str) -> tuple[int, ...]:
        k0 = token.lower() if low else token
        k1 = k0 if token.isascii() else folding.fold_text(token, low)
        found = [tests.get((0, k0)), tests.get((1, k1)), tests.get((2, stem(k1)))]
        grown = folding.hangul_grown_text(k1)
        return tuple(n for n in found if n is not None) + tuple(n for k, most, n in close if near(grown, k, most))

    known: dict[str, tuple[int, ...]] = {}

    def starts(texts: pa.Array, codes: np.ndarray, names: list[str], first: np.ndarray, last: dict[int, int]) -> np.ndarray:
        """Places of the tokens of pages, up to the last that is asked for: each is the first place of its letters from its forerunner's end on."""
        out = np.zeros(len(codes), np.int64)
        for page, to in last.items():
            find, at, places = texts[page].as_py().find, 0, []
            for c in codes[first[page] : to + 1].tolist():
                w = names[c]
                s = find(w, at)
                places.append(s)
                at = s + len(w)
            out[first[page] : to + 1] = places
        return out

    def run(doc: pa.Array, concat: pa.Array, tokens: pa.Array) -> pa.Array:
        page, entries = _flat(tokens)
        placed = pa.types.is_struct(entries.type)
        codes, terms, _ = _coded(entries.field("token") if placed else entries)
        names = terms.to_pylist()
        fits = np.zeros((len(tests), len(names)), bool)
        if len(known) > REMEMBERED:
            known.clear()
        for d, name in enumerate(names):
            found = known.get(name)
            if found is None:
                found = known[name] = judge(name)
            for t in found:
                fits[t, d] = True
        first = np.searchsorted(page, np.arange(len(tokens)))
        begin, end, about = [], [], []
        for ord_, tier, keys, many in plan:
            at = np.flatnonzero(fits[keys[0]][codes]) if keys else np.zeros(0, np.int64)
            for j, t in enumerate(keys[1:], 1):
                at = at[at + j < len(codes)]
                at = at[(page[at] == page[at + j]) & fits[t][codes[at + j]]]
            begin.append(at)
            end.append(at + len(keys) - 1)
            about.append(np.tile(np.array([ord_, tier, many, 0]), (len(at), 1)))
        b, e = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begin, end))
        about = np.concatenate(about) if about else np.zeros((0, 4), np.int64)
        own = page[b]
        if placed:
            s, e = (entries.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[i] for c, i in (("start", b), ("end", e)))
        else:
            last: dict[int, int] = {}
            for p, i in zip(own.tolist(), e.tolist()):
                last[p] = max(last.get(p, -1), i)
            place = starts(concat, codes, names, first, last)
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            s, e = place[b], place[e] + sizes[codes[e]]
        if falls:
            docs, more = doc.to_pylist(), []
            exact = {(docs[p], n) for p, n, tier in zip(own.tolist(), about[:, 0].tolist(), about[:, 1].tolist()) if tier == 0}
            for p, text in enumerate(concat.to_pylist()):
                asked = [f for f in falls if docs[p] is None or (docs[p], f[0]) not in exact]
                if asked:
                    more += [(p, n, i, j) for n, i, j in letter_places(text.lower() if low else text, asked)]
            if more:
                p, n, i, j = np.array(more, np.int64).T
                own, s, e = np.concatenate([own, p]), np.concatenate([s, i]), np.concatenate([e, j])
                about = np.concatenate([about, np.column_stack([n, np.zeros_like(n), np.ones_like(n), np.ones_like(n)])])
        order = np.argsort(own, kind="stable")
        ord_, tier, many, fall = about[order].T
        i32, yes = lambda x: x.astype(np.int32), lambda x: x.astype(bool)
        return _listed(own[order], len(tokens), term_ord=i32(ord_), tier=i32(tier), many=yes(many), fall=yes(fall), s=i32(s[order]), e=i32(e[order]))

    return run


def with_hits(pages: DataFrame, tokens: Column, find, stored: bool = False) -> DataFrame:
    """pages (doc_id, page, items, concat) with hits, by a function that ``hits`` made; stored: pages as they are in a table, whose buckets stay known."""
    names = ["doc_id", "page", "items", "concat"]
    if stored:  # an expression keeps the table's columns, and so its buckets; over computed columns it wouldn't do
        udf = F.arrow_udf(find, HITS).asNondeterministic()  # so that no filter moves below it and runs it once more
        return pages.select(*names, udf("doc_id", "concat", tokens).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], find(b.column(0), b.column(3), b.column(4))], names=[*names, "hits"])

    rows = pages.select(*names, tokens.alias("tokens"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:4], StructField("hits", DataType.fromDDL(HITS))]))


def _placed(concat: pa.Array, tokens: pa.Array) -> pa.Array:
    if len(concat) > PART:  # so that few tokens are Python objects at a time
        return pa.concat_arrays([_placed(concat.slice(at, PART), tokens.slice(at, PART)) for at in range(0, len(concat), PART)])
    page, entries = _flat(tokens)
    names, at = entries.to_pylist(), np.searchsorted(page, np.arange(len(tokens) + 1)).tolist()
    begin = []
    for text, lo, hi in zip(concat.to_pylist(), at, at[1:]):
        to = 0
        for w in names[lo:hi]:
            s = text.find(w, to)
            begin.append(s)
            to = s + len(w)
    start = np.array(begin, np.int32)
    return _listed(page, len(tokens), token=entries, start=start, end=start + np.fromiter(map(len, names), np.int32, len(names)))


def placed_tokens(text: Column) -> Column:
    """``functions.text.tokens`` of a column without nulls, over batches; for texts that are read whole anyway."""
    placed = F.arrow_udf(_placed, "array<struct<token:string,start:int,end:int>>")
    return placed(text, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
