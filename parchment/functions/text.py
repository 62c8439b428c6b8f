"""Tokens, offsets and small text predicates as Spark expressions. Offsets are code points, half-open, from zero."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
CJK = "[ᄀ-ᇿ　-鿿가-힯豈-﫿]"
SPECIAL = r"[+#(){}\[\]@$%^&*=<>~`|\\]"
#: White space as trimming takes it: Unicode's, with NBSP and the byte order mark.
BLANK = r"[\s ﻿  -     　]"
CHUNK = 32


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: a bare column expression would be computed again in each step of
    a higher-order function that mentions it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def prefix_sums(sizes: Column) -> Column:
    """Sum of all earlier entries for each entry, in chunks so that a long array stays close to linear."""
    return let(sizes, _prefix_sums)


def _prefix_sums(sizes: Column) -> Column:
    n = F.size(sizes)
    chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))

    def scan(values: Column, first: Column) -> Column:
        zero = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")))["out"]

    totals = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), add))
    inner = lambda firsts: F.flatten(F.transform(chunks, lambda c: scan(part(c), F.get(firsts, c))))
    return let(scan(totals, F.lit(0)), inner)


def tokens(text: Column) -> Column:
    """array<struct<token, start, end>>"""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, TOKEN, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda g, t: F.length(g) + F.length(t))
        ends = lambda st: F.zip_with(prefix_sums(st), st, add)
        return F.zip_with(found, let(steps, ends), lambda t, e: F.struct(t.alias("token"), (e - F.length(t)).cast("int").alias("start"), e.cast("int").alias("end")))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), placed)


def add(a: Column, b: Column) -> Column:
    return a + b


def places(haystack: Column, needle: str) -> Column:
    """Zero-based places of all, also overlapping, occurrences: the text is split before each of them, so it is read once."""
    if not needle:
        return F.array().cast("array<int>")
    parts = F.split(haystack, "(?=" + re.escape(needle) + ")", -1)
    starts = F.transform(prefix_sums(F.transform(parts, F.length)), lambda s, k: F.when((k > 0) | F.startswith(haystack, F.lit(needle)), s))
    return F.when(F.contains(haystack, F.lit(needle)), F.filter(starts, lambda s: s.isNotNull())).otherwise(F.array().cast("array<int>"))


def char_places(text: Column, pattern: str) -> Column:
    """array<int>: places of the characters that the pattern fits."""
    found = F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(pattern), i))
    return F.filter(found, lambda i: i.isNotNull())


def stripped_map(text: Column) -> Column:
    """Places of the letters and digits of the text."""
    return char_places(text, r"^[\p{L}\p{N}]$")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def item_at(items: Column, pos: Column) -> Column:
    """The item that holds place pos; on a separator the next one, past the end the last."""
    return F.coalesce(F.get(F.filter(items, lambda o: o["end"] > pos), F.lit(0)), F.element_at(items, -1))


def spans(items: Column, start: Column, end: Column) -> Column:
    """The parts of [start, end) in each item, null unless there are several."""
    over = F.filter(items, lambda o: (o["end"] > start) & (o["start"] < end))
    parts = F.transform(over, lambda o: F.struct(o["item_index"].alias("item_index"), F.greatest(start - o["start"], F.lit(0)).alias("char_start"), F.least(o["end"] - o["start"], end - o["start"]).alias("char_end")))
    return F.when(F.size(parts) > 1, parts)
