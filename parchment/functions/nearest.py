"""Where a match stands in the text that shows it, if the place given for it may be wrong. Places are half-open, from zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parchment.functions.text import BLANK, char_places, let

SPAN = "struct<start:int,end:int>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def closest(text: Column, token: Column, hint: Column) -> Column:
    """The place of the token's occurrence nearest to the hint, the earlier of two as near; null if there is none. Overlapping ones count.

    Only the first one from the hint on and the last one up to it are looked for, so a text is read once or twice and not once a place.
    """
    k, at = F.length(token), F.coalesce(hint, F.lit(0))
    start = F.greatest(at, F.lit(0))
    after = F.call_function("locate", token, text, start + 1) - 1
    head = F.substring(text, F.lit(1), start + k)
    before = let(head, lambda h: F.length(h) - k + 1 - F.nullif(F.call_function("locate", F.reverse(token), F.reverse(h), F.lit(1)), F.lit(0)))
    pair = F.struct(F.nullif(after, F.lit(-1)).alias("after"), before.alias("before"))
    nearer = lambda p: F.when(p["after"].isNull() | (at - p["before"] <= p["after"] - at), p["before"]).otherwise(p["after"])
    return F.when((k > 0) & F.contains(text, token), let(pair, nearer))


def in_bounds(text: Column, start: Column, end: Column) -> Column:
    return (start >= 0) & (end <= F.length(text)) & (start < end)


def match_in_context(context: Column, token: Column, start: Column, end: Column) -> Column:
    """The given place if the token stands there; else its occurrence nearest to it; else the given place if it is one; else null.

    Case doesn't count. The end of an occurrence follows the token's length.
    """
    low, own = F.lower(context), F.lower(token)
    trusted = in_bounds(context, start, end) & (F.substring(low, start + 1, end - start) == own)
    near = let(let(F.struct(low.alias("low"), own.alias("own")), lambda t: closest(t["low"], t["own"], start)), lambda i: F.when(i.isNotNull(), span(i, i + F.length(token))))
    return F.when(trusted, span(start, end)).otherwise(F.coalesce(near, F.when(in_bounds(context, start, end), span(start, end))))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def token_in_span(text: Column, token: Column, hint: Column) -> Column:
    """The token's occurrence nearest to the hint; else its first one if white space is left out on both sides, mapped back; else
    the hint if the token would fit there; else null."""
    low, own = F.lower(text), F.lower(token)
    near = let(let(F.struct(low.alias("low"), own.alias("own")), lambda t: closest(t["low"], t["own"], hint)), lambda i: F.when(i.isNotNull(), span(i, i + F.length(token))))
    bare = without_blanks(own)
    at, size = F.instr(without_blanks(low), bare), F.length(bare)
    mapped = let(char_places(text, f"^[^{BLANK[1:-1]}]$"), lambda m: span(F.get(m, at - 1), F.get(m, at + size - 2) + 1))
    # where lower case keeps every place, a pattern finds the token at once
    letters = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
    found = lambda p: let(F.length(F.get(F.split(low, p, 2), F.lit(0))), lambda i: span(i, i + F.length(F.regexp_substr(low, p))))
    mapped = F.when(F.length(low) == F.length(text), let(F.array_join(letters, BLANK + "*"), found)).otherwise(mapped)
    fits = (hint >= 0) & (hint + F.length(token) <= F.length(text))
    return F.coalesce(near, F.when((size > 0) & (at > 0), mapped), F.when(fits, span(hint, hint + F.length(token))))
