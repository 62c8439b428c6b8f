"""Packing by optimal length buckets.

Sequences are the documents' tokens, cut into pieces of at most ``max_tokens``. A global
histogram of piece lengths (at most ``max_tokens`` rows, so the driver's share is bounded at
any corpus size) goes through dynamic programming:

    best(k, j) = min over i < j of best(k - 1, i) + sum over lengths l in (i, j] of count(l) * (length j - l)

which gives the ``buckets`` upper bounds of least total padding. Every piece is padded to its
bucket's bound, and inside a bucket batches of floor(token_budget / bound) rows form, so that
no batch exceeds the token budget.

Batches are numbered without putting a bucket into one task: each bucket is dealt to shards
by a hash, rows are numbered inside a shard, and the shards' sizes, summed in order, give
each shard its first number. The numbering is dense in a bucket, so only its last batch
isn't full, and it depends on the rows alone, not on the partitioning. The number of shards
follows the number of rows.

Results for odd input: null, empty and token-less texts make no piece, as there is nothing to
train on; rows that repeat a doc_id are pieces of their own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
import numpy as np

from parchment.llm import token_counts
from parchment.llm.storage import store

MAX_TOKENS = 4096
BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 20_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Bucket bounds of least padding, and that padding. lengths: ascending and distinct."""
    n = len(lengths)
    if not n:
        return [], 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.r_[0, np.cumsum(counts)]
    tokens = np.r_[0, np.cumsum(counts * lengths)]
    best = np.r_[0, np.full(n, np.iinfo(np.int64).max // 4)]
    choice = []
    for _ in range(min(buckets, n)):
        new, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        best = new
        choice.append(cut)
    bounds, j, k = [], n, len(choice) - 1
    while j > 0:
        while choice[k][j] < 0:  # no better with this many buckets
            k -= 1
        bounds.append(int(lengths[j - 1]))
        j, k = int(choice[k][j]), k - 1
    return bounds[::-1], int(best[n])


def pieces(lengths: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) -> (doc_id, piece, start, length): runs of at most max_tokens tokens."""
    at = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(max_tokens).cast("bigint"))).alias("piece", "start")
    return lengths.filter("n_tokens > 0").select("doc_id", "n_tokens", at).select("doc_id", "piece", "start", F.least(F.col("n_tokens") - F.col("start"), F.lit(max_tokens)).alias("length"))


def pack_lengths(lengths: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, n_tokens) -> a row for each piece: doc_id, piece, start, length, bucket, padded, batch, slot."""
    if token_budget < max_tokens:
        raise ValueError("a batch must hold the longest piece")
    # the copy number tells rows that repeat a doc_id and length apart
    copy = lengths.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("c")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    cut = store(pieces(copy.select("doc_id", "n_tokens", "copy").withColumn("doc", F.struct("doc_id", "copy")).select(F.col("doc").alias("doc_id"), "n_tokens"), max_tokens))
    hist = cut.groupBy("length").count().toArrow().sort_by("length")
    sizes, counts = hist.column("length").to_numpy(), hist.column("count").to_numpy()
    bounds, _ = optimal_bounds(sizes, counts, buckets)
    total = int(counts.sum()) if len(counts) else 0
    shards = max(1, -(-total // shard_rows))
    if bounds:
        bucket, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1]).cast("bigint")
        for k in range(len(bounds) - 2, -1, -1):
            bucket = F.when(F.col("length") <= bounds[k], k).otherwise(bucket)
            padded = F.when(F.col("length") <= bounds[k], F.lit(bounds[k]).cast("bigint")).otherwise(padded)
    else:
        bucket, padded = F.lit(0), F.lit(1).cast("bigint")
    shard = F.pmod(F.xxhash64("doc_id.doc_id", "doc_id.copy", "piece"), F.lit(shards)).cast("int")
    rows = cut.select("doc_id", "piece", "start", "length", bucket.alias("bucket"), padded.alias("padded"), shard.alias("shard"))
    own = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece")
    rows = rows.withColumn("n", F.row_number().over(own) - 1)
    # at most buckets * shards sums; one window a bucket over them
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("bucket", "shard").agg(F.count("*").alias("c")).withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    rows = rows.join(offset, ["bucket", "shard"]).withColumn("n", F.col("n") + F.col("first"))
    per = F.floor(F.lit(token_budget) / F.col("padded"))
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("piece").cast("int"), "start", "length", F.col("bucket").cast("int").alias("bucket"), "padded", F.floor(F.col("n") / per).alias("batch"), (F.col("n") % per).alias("slot"))


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str | None = None, **kw) -> DataFrame:
    """Pieces of all documents, packed by their exact token counts."""
    n = token_counts.prefix_counts(docs, text_col, id_col, model, tables=False)
    return pack_lengths(n.select("doc_id", "n_tokens"), **kw)
