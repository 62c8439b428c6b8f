"""Accent and compatibility folding as Spark expressions.

Folding takes each character by itself: NFKC, then NFD, then drops U+0300 to U+036F. The
tables are made from Python's Unicode data for the whole BMP: characters that fold to one
character or none go through ``translate``; the few that grow (ligatures, unit signs) are
looked up only in texts that a regular expression finds them in.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from parchment.functions.text import let

HANGUL = (0xAC00, 0xD7A3)


def fold_char(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c)) if not "̀" <= x <= "ͯ")


@lru_cache(1)
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for translate, characters without a partner in ``to`` vanish; and the characters that grow."""
    one, gone, grow = [], [], {}
    for n in range(0x80, 0xFFFF):
        if 0xD800 <= n <= 0xDFFF or HANGUL[0] <= n <= HANGUL[1]:
            continue
        c = chr(n)
        f = fold_char(c)
        if f == c:
            continue
        if len(f) == 1:
            one.append((c, f))
        elif not f:
            gone.append(c)
        else:
            grow[c] = f
    return "".join(c for c, _ in one) + "".join(gone), "".join(f for _, f in one), grow


def fold(text: Column, lower: bool = True) -> Column:
    """The folded text; Hangul syllables stay whole (see hangul_grown)."""
    source, target, grow = tables()
    some = "[" + "".join(sorted(grow)) + "]"
    grown = F.create_map(*(F.lit(x) for c, f in grow.items() if f.isalnum() for x in (c, f)))
    by_char = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(grown, c), c)), "")
    out = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.translate(F.when(text.rlike(some), by_char).otherwise(text), source, target))
    return F.lower(out) if lower else out


@lru_cache(1)
def _translations() -> tuple[dict, dict]:
    source, target, grow = tables()
    return {ord(c): f for c, f in grow.items() if f.isalnum()}, {ord(c): target[k] if k < len(target) else None for k, c in enumerate(source)}


def fold_text(text: str, lower: bool = True) -> str:
    """``fold`` of one text."""
    grown, one = _translations()
    out = text.translate(grown).translate(one)
    return out.lower() if lower else out


class _Each(dict):
    """Code point -> what that character alone folds to, filled as they are met; Hangul syllables become their two or three letters."""

    def __init__(self, lower: bool) -> None:
        super().__init__()
        self.lower = lower

    def __missing__(self, n: int) -> str:
        c = chr(n)
        out = fold_char(c) if n < 0xFFFF else c  # as ``tables`` do
        self[n] = out = out.lower() if self.lower else out
        return out


def fold_map(text: Column, lower: bool = True) -> Column:
    """struct<folded, at>: the text folded character by character, and for each folded character the place of its own in the text.

    Characters that fold to several have several places alike, those that vanish have none, so any span of the folded text leads back.
    """
    import numpy as np
    import pyarrow as pa

    each, sizes = _Each(lower), []  # sizes: made in the worker, for each code point how many characters it becomes

    def run(texts: pa.Array) -> pa.Array:
        if not sizes:
            sizes.append(np.full(0x110000, -1, np.int8))
        known, rows = sizes[0], texts.to_pylist()
        own = [t or "" for t in rows]
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        for n in np.unique(codes[known[codes] < 0]).tolist():
            known[n] = len(each[n])
        n_each, lengths = known[codes], np.fromiter(map(len, own), np.int64, len(own))
        begin = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(np.arange(len(codes)) - np.repeat(begin[:-1], lengths), n_each).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(n_each, dtype=np.int64)])[begin]
        none = np.array([t is None for t in rows], bool)
        folded = pa.array([None if t is None else t.translate(each) for t in rows], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(none, False)) if none.any() else pa.array(ends.astype(np.int32)), pa.array(at))
        return pa.StructArray.from_arrays([folded, lists], names=["folded", "at"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<folded:string,at:array<int>>")(text)


def original_span(at: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: the part of the text that a span of the folded text comes from, whole characters."""
    return F.struct(F.get(at, start).alias("start"), (F.get(at, end - 1) + 1).alias("end"))


def hangul_grown(key: Column) -> Column:
    """The key with each Hangul syllable as long as its decomposition (2 or 3 characters), for edit distances."""
    open_ = "".join(chr(n) for n in range(HANGUL[0], HANGUL[1] + 1, 28))
    return F.when(key.rlike("[가-힣]"), F.regexp_replace(F.regexp_replace(key, f"[{open_}]", "가"), "[가-힣]", "각")).otherwise(key)


def hangul_grown_text(key: str) -> str:
    """``hangul_grown`` of one key: only lengths count."""
    syllable = lambda m: "\u1100\u1161" if (ord(m[0]) - HANGUL[0]) % 28 == 0 else "\u1100\u1161\u11a8"
    return key if key.isascii() else re.sub("[\uac00-\ud7a3]", syllable, key)


def stem(key: Column) -> Column:
    """Light suffix rules for keys of a-z only; the first that applies wins."""
    return let(key, _stem)


def _stem(key: Column) -> Column:
    n = F.length(key)
    cut = lambda k: F.substring(key, F.lit(1), n - k)
    return (
        F.when(~(key.endswith("s") | key.endswith("ing") | key.endswith("ed")), key)  # spares most keys the pattern
        .when(~key.rlike("^[a-z]+$"), key)
        .when(key.endswith("ies") & (n >= 5), F.concat(cut(3), F.lit("y")))
        .when(key.endswith("es") & (n >= 5), F.when(cut(2).rlike("(s|x|z|ch|sh)$"), cut(2)).otherwise(cut(1)))
        .when(key.endswith("s") & ~key.endswith("ss") & (n >= 4), cut(1))
        .when(key.endswith("ing") & (n >= 6), cut(3))
        .when(key.endswith("ed") & (n >= 5), cut(2))
        .otherwise(key)
    )
