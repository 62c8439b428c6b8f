"""Keyword lists kept by document and algorithm, so that a later run works on what has changed only.

Below ``path``, ``lists/run=N`` holds the lists that run N made and ``states/run=N`` what it settled: a row for each (document,
algorithm) with the hash of the text, or with ``gone`` for documents that are no longer there. A run writes its states last, so one that
breaks off has settled nothing and is made again. The newest state of a document and algorithm says which run's list is
its current one; that holds also for documents whose list is empty.

Documents are told by doc_id, which must not repeat; a null doc_id is one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parchment.operators.keywords import ALGORITHMS, keywords

STATE = "doc_id bigint, algorithm string, th bigint, gone boolean"


class KeywordCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, folder: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def states(self) -> DataFrame:
        """(doc_id, algorithm, th, gone, run): the newest of each document and algorithm."""
        if not self._exists("states"):
            return self.spark.createDataFrame([], STATE + ", run int")
        newest = Window.partitionBy("doc_id", "algorithm").orderBy(F.desc("run"))
        rows = self.spark.read.schema(STATE + ", run int").parquet(f"{self.path}/states")
        return rows.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")

    def changed(self, docs: DataFrame, algorithms: tuple[str, ...] = ALGORITHMS) -> DataFrame:
        """(doc_id, algorithm, th, gone) of what a run has to settle: new and changed texts, and documents that went."""
        now = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
        wanted = now.withColumn("algorithm", F.explode(F.array(*map(F.lit, algorithms))))
        known = self.states().filter(F.col("algorithm").isin(*algorithms)).select(F.col("doc_id").alias("d"), F.col("algorithm").alias("a"), F.col("th").alias("h"), F.col("gone").alias("g"))
        j = wanted.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("algorithm") == F.col("a")), "full_outer")
        left = F.col("algorithm").isNull()
        rows = j.filter(F.when(left, ~F.col("g")).otherwise(F.col("h").isNull() | F.col("g") | (F.col("h") != F.col("th"))))
        return rows.select(F.when(left, F.col("d")).otherwise(F.col("doc_id")).alias("doc_id"), F.coalesce("algorithm", "a").alias("algorithm"), "th", left.alias("gone"))

    def refresh(self, docs: DataFrame, algorithms: tuple[str, ...] = ALGORITHMS) -> int:
        """Settles what has changed; returns the number of (document, algorithm) pairs that were settled."""
        run = (self.states().agg(F.max("run")).first()[0] or 0) + 1
        todo = f"{self.path}/work/run={run}"
        self.changed(docs, algorithms).write.mode("overwrite").parquet(todo)
        work = self.spark.read.schema(STATE).parquet(todo)
        n = work.count()
        if not n:
            return 0
        out = None
        for name in algorithms:
            mine = work.filter((F.col("algorithm") == name) & ~F.col("gone")).select(F.col("doc_id").alias("w"))
            lists = keywords(docs.join(mine, F.col("doc_id").eqNullSafe(F.col("w")), "left_semi"), (name,))
            out = lists if out is None else out.unionByName(lists)
        out.write.mode("overwrite").parquet(f"{self.path}/lists/run={run}")
        work.write.mode("overwrite").parquet(f"{self.path}/states/run={run}")
        return n

    def lists(self, algorithms: tuple[str, ...] = ALGORITHMS) -> DataFrame:
        """The current keyword rows of the chosen algorithms."""
        if not self._exists("states"):
            raise ValueError("nothing has been settled below this path")
        own = self.states().filter(~F.col("gone") & F.col("algorithm").isin(*algorithms)).select(F.col("doc_id").alias("d"), F.col("algorithm").alias("a"), F.col("run").alias("r"))
        rows = self.spark.read.parquet(f"{self.path}/lists")
        return rows.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("algorithm") == F.col("a")) & (F.col("run") == F.col("r")), "left_semi").drop("run")


def toggled(active: DataFrame, changes: DataFrame) -> DataFrame:
    """active (doc_id, term), changes (doc_id, term) -> the terms that are active after each of the changes was switched once.

    A term switched an even number of times stays as it was.
    """
    flips = changes.groupBy("doc_id", "term").agg((F.count("*") % 2).alias("n"))
    both = active.select("doc_id", "term").distinct().withColumn("n", F.lit(1).cast("bigint")).unionAll(flips)
    return both.groupBy("doc_id", "term").agg((F.sum("n") % 2).alias("n")).filter("n = 1").select("doc_id", "term")
