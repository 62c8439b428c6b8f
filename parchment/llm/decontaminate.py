"""Benchmark decontamination: a broadcast hash set of the test texts' word windows.

DataFrame functions only. Each document is cut into words once, in its row; the 64-bit hash
of the window at each word is looked up in the set, and the text never meets a shuffle. A hit is then verified on the words themselves, still in the document's own stage,
so that a hash collision cannot count. What is shuffled is one short row a hit.

The set is broadcast only while it has at most ``broadcast_windows`` windows and about
``broadcast_bytes`` (both are counted first); for a larger set the places' hashes alone are
shuffled (``_shuffled_hits``), with the same rows.

Nulls and texts without words have no windows. Repeated rows of one document each get the
document's result. Texts are read whole at any length; columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parchment.llm.rows import col, numbered, restored
from parchment.llm.storage import store

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character that is neither a letter nor a digit.
#: Looked up once for each document. A window's hash that equals it fails the check on its place.
OWN = -0x5EED_0F_D0C5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def _window_hash(ws: Column, at: Column | int, size: int) -> Column:
    """Hash of the ``size`` words from place ``at``; past the end it hashes what there is."""
    return F.xxhash64(*(F.get(ws, at + k) for k in range(size)))


def benchmark_windows(bench: DataFrame, text_col: str = "text", id_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(h, size, ws, items): each distinct window with the items that have it. A shorter item is one window."""
    cut = bench.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    cut = cut.withColumn("size", F.least(F.size("all"), F.lit(window)))
    runs = F.transform(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1), lambda i: F.slice(F.col("all"), i, F.col("size")))
    each = cut.select("item", "size", F.explode(F.array_distinct(runs)).alias("ws"))
    h = F.coalesce(*(F.when(F.col("size") == k, _window_hash(F.col("ws"), F.lit(0), k)) for k in range(1, window + 1)))
    return each.groupBy(h.alias("h"), "size", "ws").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, bench_text: str = "text", bench_id: str = "item_id", broadcast_windows: int = 2_000_000, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, th, n_words, at, size, items): a row for each verified window of a document.

    Besides these, each document has one row with null ``at``, so that none is lost. ``th``
    hashes the text, so that rows that share a doc_id but not a text stay apart.
    """
    held = store(benchmark_windows(bench, bench_text, bench_id, window))
    sizes = [r[0] for r in held.select("size").distinct().collect()] or [window]  # at most ``window`` of them
    n, n_bytes = held.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("ws", " ")) + 24 * F.size("ws") + 24 * F.size("items")), F.lit(0))).first()
    cut = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("th"), words(col(text_col)).alias("ws"))
    if n > broadcast_windows or n_bytes > broadcast_bytes:
        return _shuffled_hits(cut, held, sizes)
    items = held.schema["items"].dataType
    out = None
    for size in sizes:
        part = held.filter(F.col("size") == size).select(F.col("h").alias("bench_h"), "size", F.col("ws").alias("bench_ws"), "items")
        # Everything from the scan to the join is generated code: the words stay a local array, no row holds them.
        at_word = F.posexplode_outer(F.concat("ws", F.array(F.lit(None).cast("string")))).alias("at", "w")
        h = _window_hash(F.col("ws"), F.col("at"), size)
        if out is None:  # one more look-up a document, which always succeeds, keeps documents without a hit
            part = part.unionAll(docs.sparkSession.range(1).select(F.lit(OWN).cast("bigint"), F.lit(None).cast("int"), F.lit(None).cast("array<string>"), F.lit(None).cast(items)))
            h = F.when(F.col("at") == F.size("ws"), F.lit(OWN).cast("bigint")).otherwise(h)
        spread = cut.select("doc_id", "th", "ws", at_word).select("doc_id", "th", "ws", "at", h.alias("h"))
        here = F.slice("ws", F.col("at") + 1, F.lit(size))
        # Two inequalities: an equality would become a join key and be computed for every window.
        same = (here <= F.col("bench_ws")) & (here >= F.col("bench_ws"))
        own = F.col("bench_ws").isNull() & (F.col("at") == F.size("ws"))
        hit = spread.join(F.broadcast(part), (F.col("h") == F.col("bench_h")) & (own | same))
        hit = hit.select("doc_id", "th", F.size("ws").alias("n_words"), F.when(F.col("size").isNotNull(), F.col("at")).alias("at"), "size", "items")
        out = hit if out is None else out.unionAll(hit)
    return out


def _shuffled_hits(cut: DataFrame, held: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of ``find_hits`` for a set too large to broadcast; cut is (doc_id, th, ws).

    One scan for all sizes shuffles a row of four numbers a window, no words. The places whose
    hash is in the set are gathered by row, the words there are cut in a second scan, and those
    are compared with the set's. A window that many documents share is one key; its rows are on the side
    that is only filtered, which the engine may split, and each place goes there once.
    """
    own = cut.select("doc_id", "th", F.size("ws").alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("size"), F.lit(None).cast(held.schema["items"].dataType).alias("items"))
    runs = F.array(*(F.struct(F.lit(k).alias("size"), F.when(F.col("at") <= F.size("ws") - k, _window_hash(F.col("ws"), F.col("at"), k)).alias("h")) for k in sizes))
    each = cut.select("doc_id", "th", "ws", F.posexplode("ws").alias("at", "w")).select("doc_id", "th", "at", F.explode(runs).alias("run"))
    each = each.select("doc_id", "th", "at", F.col("run.size").alias("size"), F.col("run.h").alias("h")).filter("h is not null")
    met = store(each.join(held.select("h", "size").distinct(), ["h", "size"], "left_semi").distinct())
    places = met.groupBy(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th")).agg(F.collect_set(F.struct("at", "size", "h")).alias("places"))
    back = cut.join(places, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")))
    read = back.select("doc_id", "th", F.size("ws").alias("n_words"), "ws", F.explode("places").alias("p"))
    read = read.select("doc_id", "th", "n_words", "p.at", "p.size", "p.h", F.slice("ws", F.col("p.at") + 1, F.col("p.size")).alias("ws"))
    return own.unionAll(read.join(held, ["h", "size", "ws"]).select("doc_id", "th", "n_words", "at", "size", "items"))


def _covered(spans: Column) -> Column:
    """Words under a sorted array of (at, size) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["at"] + x["size"] - F.greatest(s["end"], x["at"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], x["at"] + x["size"]).alias("end"),
        ),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (array), spans (array of word offset and length), contaminated.

    An empty corpus gives no rows, an empty benchmark no hits.
    """
    hits = find_hits(docs, bench, **kw)
    g = hits.groupBy("doc_id", "th").agg(
        F.count(F.when(F.col("at").isNull(), 1)).alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "size")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    g = g.withColumn("n_hit", _covered(F.col("spans")))
    return g.select(
        F.col("doc_id"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        "n_words", "n_hit", "spans", F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"), "th",
    ).select("doc_id", "th", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, max_share: float = 0.0, text_col: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents of which at most ``max_share`` of the words are hit, with all their columns.

    Only hit documents are grouped and joined, by an anti join on id and text hash; a clean
    document's text stays in its scan unless the list is too long to broadcast.
    """
    hits = find_hits(docs, bench, text_col=text_col, id_col=id_col, **kw).filter("at is not null")
    g = hits.groupBy("doc_id", "th").agg(F.max("n_words").alias("n"), F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"))
    bad = store(g.filter(_covered(F.col("spans")) > F.lit(max_share) * F.col("n")).select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")))
    rows, names = numbered(docs)
    return restored(rows.join(bad, F.col("bad_id").eqNullSafe(F.col(names[id_col])) & (F.xxhash64(F.col(names[text_col])) == F.col("bad_th")), "left_anti"), names)


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """All documents, the hit words and the separators that follow them cut out of the text."""
    hits = find_hits(docs, bench, text_col=text_col, id_col=id_col, **kw).filter("at is not null")
    flat = hits.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("i"))
    cut = store(flat.groupBy("__id", "__th").agg(F.collect_set("i").alias("__cut")))
    lead = F.regexp_extract(F.col(text_col), rf"^(?:{GAP})?", 0)
    rest = F.substring(F.col(text_col), F.length(lead) + 1, F.length(F.col(text_col)))
    pieces = F.regexp_extract_all(rest, F.lit(rf"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:{GAP})?"), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__cut"))
    new = F.concat(lead, F.array_join(F.transform(keep, lambda i: F.get(pieces, i)), ""))
    joined = docs.join(cut, F.col("__id").eqNullSafe(docs[id_col]) & (F.xxhash64(docs[text_col]) == F.col("__th")), "left")
    return joined.withColumn(text_col, F.when(F.col("__cut").isNotNull(), new).otherwise(F.col(text_col))).select(*docs.columns)
