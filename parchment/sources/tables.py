"""The driver tables, and documents seen as pages of items.

A document's lines are its items and five lines make a page; blank lines are dropped but
counted, so item numbers can have gaps. All of it happens inside a document's row: pages are
built by array functions and exploded, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parchment.functions.text import BLANK, prefix_sums
from parchment.session import ship

LINES_PER_PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer parts than the session has cores (a small file is one row group) is dealt out to all of them."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def all_pages(docs: DataFrame, separator: str = " ") -> DataFrame:
    """(doc_id, page, items, concat): every page, blank ones too. items: array<struct<item_index, text, start, end>>.

    docs: documents, or a table of stored pages, which also has toks if the separator is theirs.
    """
    if not isinstance(docs, DataFrame):
        return docs.pages if separator == " " else _joined_by(docs.pages, separator)
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    numbers = F.explode(F.sequence(F.lit(1), F.ceil(F.size("ls") / LINES_PER_PAGE).cast("int"))).alias("page")
    part = lines.select("doc_id", "ls", numbers).select("doc_id", "page", F.slice("ls", (F.col("page") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)).alias("part"))
    numbered = F.transform("part", lambda t, i: F.struct(i.alias("item_index"), t.alias("text")))
    some = part.select("doc_id", "page", F.filter(numbered, lambda o: ~o["text"].rlike(f"^{BLANK}*$")).alias("own"))
    return _joined_by(some.withColumnRenamed("own", "items"), separator)


def _joined_by(pages: DataFrame, separator: str) -> DataFrame:
    """Pages whose items (item_index, text, ..) get their places in the text joined by the separator."""
    starts = prefix_sums(F.transform("items", lambda o: F.length(o["text"]) + len(separator)))
    items = F.zip_with("items", starts, lambda o, s: F.struct(o["item_index"].alias("item_index"), o["text"].alias("text"), s.alias("start"), (s + F.length(o["text"])).alias("end")))
    return pages.select("doc_id", "page", items.alias("items"), F.array_join(F.transform("items", lambda o: o["text"]), separator).alias("concat"))


def pages(docs: DataFrame, separator: str = " ") -> DataFrame:
    return all_pages(docs, separator).filter(F.size("items") > 0)


def items(docs: DataFrame) -> DataFrame:
    """(doc_id, page, item_index, text, start, end)"""
    return pages(docs).select("doc_id", "page", F.explode("items").alias("o")).select("doc_id", "page", "o.item_index", "o.text", "o.start", "o.end")
