"""Matches as a list to scroll: page headers and rows with heights, the part that a window shows, and the place kept in it.

A list belongs to a document, so a window over its matches is bounded by the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ORDER = ("page", "item_index", "term_ord", "tier", "char_start")
HEADER, ROW, OVERSCAN = 28, 56, 10


def by_page(matches: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(doc_id, header, page, kind, n, global_index, id, label, first, gi): a header for each page, then its matches.

    Pages come in the order in which they are first seen, and header is their number in it; global_index is the match's place
    among all matches of the document and null for a header, n the header's number of matches and null for a match. In the
    order of first, gi and kind a header comes with its first match, as "header" sorts before "result".
    """
    own = Window.partitionBy("doc_id")
    by_page = Window.partitionBy("doc_id", "page")
    m = matches.withColumn("gi", (F.row_number().over(own.orderBy(*order)) - 1).cast("bigint"))
    m = m.withColumn("first", F.min("gi").over(by_page)).withColumn("n", F.count("*").over(by_page))
    m = m.withColumn("header", F.dense_rank().over(own.orderBy("first")))
    none = F.lit(None)
    a_header = F.struct(F.lit("header").alias("kind"), F.col("n").alias("n"), none.cast("bigint").alias("global_index"), none.cast("string").alias("id"), none.cast("string").alias("label"))
    a_row = F.struct(F.lit("result").alias("kind"), none.cast("bigint").alias("n"), F.col("gi").alias("global_index"), F.col("id").alias("id"), F.col("label").alias("label"))
    rows = m.select("doc_id", "header", "page", "first", "gi", F.explode(F.when(F.col("gi") == F.col("first"), F.array(a_header, a_row)).otherwise(F.array(a_row))).alias("x"))
    return rows.select("doc_id", "header", "page", "x.*", "first", "gi")


def list_rows(matches: DataFrame, order: tuple[str, ...] = ORDER, header: int = HEADER, row: int = ROW) -> DataFrame:
    """(doc_id, row_no, kind, page, n, global_index, id, label, top, height): each page's header, then its matches (see ``by_page``); top sums the heights above."""
    rows = by_page(matches, order).withColumn("height", F.when(F.col("kind") == "header", header).otherwise(row))
    down = Window.partitionBy("doc_id").orderBy("first", "gi", "kind")
    rows = rows.withColumn("row_no", F.row_number().over(down) - 1).withColumn("top", F.sum("height").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("height"))
    return rows.select("doc_id", "row_no", "kind", "page", "n", "global_index", "id", "label", F.col("top").cast("bigint").alias("top"), "height")


def visible(rows: DataFrame, scroll_top: Column | int, view_height: Column | int, overscan: int = OVERSCAN) -> DataFrame:
    """The rows of each list between the first that reaches below ``scroll_top`` and the first that begins below the view, and
    ``overscan`` more on either side."""
    top, view = (x if isinstance(x, Column) else F.lit(x) for x in (scroll_top, view_height))
    own = Window.partitionBy("doc_id")
    r = rows.withColumn("size", F.count("*").over(own))
    r = r.withColumn("from_row", F.greatest(F.lit(0), F.coalesce(F.min(F.when(F.col("top") + F.col("height") > top, F.col("row_no"))).over(own), F.lit(0)) - overscan))
    below = F.min(F.when((F.col("row_no") >= F.col("from_row")) & (F.col("top") > top + view), F.col("row_no"))).over(own)
    r = r.withColumn("to_row", F.least(F.col("size"), F.coalesce(below, F.col("size")) + overscan))
    return r.filter((F.col("row_no") >= F.col("from_row")) & (F.col("row_no") < F.col("to_row"))).drop("size", "from_row", "to_row")


def kept_index(before: DataFrame, after: DataFrame) -> DataFrame:
    """before (doc_id, terms, n, at), after (doc_id, terms, n) -> (doc_id, again, at): the place in the new results.

    A search for the same terms as the last, which had results, keeps the place if it still is one; any other begins at the first
    result, or at -1 if there is none. A document without earlier results is new.
    """
    b = before.select("doc_id", F.col("terms").alias("old_terms"), F.col("n").alias("old_n"), F.col("at").alias("old_at"))
    again = F.coalesce((F.col("old_n") > 0) & (F.col("old_terms") == F.col("terms")), F.lit(False))
    keeps = again & (F.col("old_at") >= 0) & (F.col("old_at") < F.col("n"))
    j = after.join(b, "doc_id", "left")
    return j.select("doc_id", again.alias("again"), F.when(keeps, F.col("old_at")).when(F.col("n") > 0, 0).otherwise(-1).cast("bigint").alias("at"))


def go_to(matches: DataFrame, current: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """current (doc_id, at, wanted) -> (doc_id, at, page): the wanted result if there is one of that number, else the place stays.

    page is the page of the result, null where there is none.
    """
    m = matches.withColumn("gi", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("bigint")).select("doc_id", "gi", "page")
    sizes = m.groupBy("doc_id").agg(F.count("*").alias("n"))
    c = current.join(sizes, "doc_id", "left").withColumn("to", F.when((F.col("wanted") >= 0) & (F.col("wanted") < F.coalesce("n", F.lit(0))), F.col("wanted")).otherwise(F.col("at")))
    return c.join(m.withColumnRenamed("gi", "to"), ["doc_id", "to"], "left").select("doc_id", F.col("to").cast("bigint").alias("at"), "page")
