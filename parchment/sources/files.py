"""Files as they are uploaded: what a guard lets in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_BYTES = 10 * 1024 * 1024


def scan_guard(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, accepted, reason) of the files below a path, without reading their bytes: PDF of at most 10 MiB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    reason = F.when(~F.lower("path").endswith(".pdf"), "type").when(F.col("length") > MOST_BYTES, "size")
    return files.select("path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))
