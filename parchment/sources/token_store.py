"""Pages with their tokens, written once and read by search and keywords.

The table holds every page of each document, its items, text and tokens with offsets, bucketed by document and sorted
by page. What works within a document (counts, ranks, sequences, the fallback's documents without an exact hit) then
needs no exchange, and nothing is tokenised again. A ``Stored`` goes wherever a function takes documents.

Tables lie in the session's ``spark.checkpoint.dir``, which all executors share; a local session without one gets a
temporary folder. ``stored`` keeps one table for each state of a documents table, told by its files.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from parchment.operators.token_hits import placed_tokens
from parchment.sources.tables import all_pages

BUCKETS = 64
_KNOWN: dict[tuple, str] = {}


@dataclass(frozen=True)
class Stored:
    """pages: (doc_id, page, items, concat, toks), blank pages too."""

    pages: DataFrame
    name: str


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parchment-"))
    return spark.sparkContext.getCheckpointDir()


def write_store(docs: DataFrame, buckets: int = BUCKETS) -> Stored:
    """Tokenises docs once and writes the table."""
    spark, name = docs.sparkSession, f"parchment_tokens_{uuid.uuid4().hex}"
    rows = all_pages(docs).withColumn("toks", placed_tokens(F.col("concat"))).repartition(buckets, "doc_id")
    rows.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "page").option("path", f"{_folder(spark)}/{name}").saveAsTable(name)
    return Stored(spark.table(name), name)


def stored(docs: DataFrame, buckets: int = BUCKETS) -> Stored:
    """The table of docs, which are read from files; written unless this session has it of these very files."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64("*") % 1_000_003), F.bit_xor(F.xxhash64("*"))).first()
    key = (spark.sparkContext.applicationId, buckets, *state)
    if key not in _KNOWN or not spark.catalog.tableExists(_KNOWN[key]):
        _KNOWN[key] = write_store(docs, buckets).name
    return Stored(spark.table(_KNOWN[key]), _KNOWN[key])


def drop_store(store: Stored) -> None:
    """Removes the table and its files."""
    spark = store.pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/{store.name}")
    spark.sql(f"DROP TABLE IF EXISTS {store.name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
