"""Word, sentence and paragraph around a place of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[\p{L}\p{N}'-]"
#: Sentence ends; a full stop between digits or between ASCII letters isn't one.
END = r"(?:[!?。！？]|(?<![0-9](?=\.[0-9]))(?<![A-Za-z](?=\.[A-Za-z]))\.)"
CLOSERS = "[\"')\\]”’»]"


def word_at(text: Column, at: Column) -> tuple[Column, Column]:
    """[start, end) of the word at a place; a place just behind a word belongs to it, else the next word; null without one."""
    left = F.regexp_extract(F.substring(text, F.lit(1), at), f"{WORD}*$", 0)
    right = F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^{WORD}*", 0)
    here = (F.length(left) > 0) | (F.length(right) > 0)
    rest = F.substring(text, at + 1, F.length(text))
    gap = F.length(F.regexp_extract(rest, "^(?:(?!" + WORD + r")[\s\S])*", 0))
    following = F.regexp_extract(F.substring(rest, gap + 1, F.length(text)), f"^{WORD}*", 0)
    start = F.when(here, at - F.length(left)).when(F.length(following) > 0, at + gap)
    end = F.when(here, at + F.length(right)).when(F.length(following) > 0, at + gap + F.length(following))
    return start.cast("int"), end.cast("int")


def sentence_ends(text: Column) -> Column:
    """array<int>: places of the characters that end sentences."""
    from parchment.functions.text import prefix_sums

    parts = F.split(text, "(?=" + END + ")", -1)
    starts = F.transform(prefix_sums(F.transform(parts, lambda p: F.length(p))), lambda s, k: F.when((k > 0) | F.regexp_like(text, F.lit("^" + END)), s))
    return F.filter(starts, lambda s: s.isNotNull())


def sentence_at(text: Column, at: Column) -> tuple[Column, Column]:
    """[start, end) of the sentence at a place: from behind the last end before it, blanks skipped, through the next end and its closing marks."""
    ends = sentence_ends(text)
    before = F.array_max(F.filter(ends, lambda e: e < at))
    after = F.array_min(F.filter(ends, lambda e: e >= at))
    first = F.coalesce(before + 1, F.lit(0))
    lead = F.length(F.regexp_extract(F.substring(text, first + 1, F.length(text)), rf"^{CLOSERS}*\s*", 0))
    tail = F.length(F.regexp_extract(F.substring(text, after + 2, F.length(text)), f"^{CLOSERS}*", 0))
    end = F.coalesce(after + 1 + tail, F.length(text))
    return F.least(first + lead, end).cast("int"), end.cast("int")


def paragraphs(items: DataFrame, anchor: Column, default_height: float = 12.0) -> DataFrame:
    """items (doc_id, page, item_index, y, height) -> those that reach the page's anchor item over steps of at most 1.5 of its height."""
    page = Window.partitionBy("doc_id", "page")
    line = page.orderBy("item_index")
    h = F.max(F.when(anchor, F.coalesce(F.when(F.col("height") > 0, F.col("height")), F.lit(default_height)))).over(page)
    df = items.withColumn("is_anchor", anchor).withColumn("h", h)
    df = df.withColumn("cut", F.coalesce((F.abs(F.col("y") - F.lag("y").over(line)) > 1.5 * F.col("h")).cast("int"), F.lit(0)))
    df = df.withColumn("part", F.sum("cut").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("own", F.max(F.when(F.col("is_anchor"), F.col("part"))).over(page))
    return df.filter("part = own").drop("is_anchor", "h", "cut", "part", "own")


def next_level(level: Column) -> Column:
    return F.when(level == "word", "sentence").otherwise("paragraph")
