"""Places of tokens in long texts."""

from pyspark.sql import functions as F

from parchment.functions import nearest as N


def test_places_in_a_long_text(spark):
    """A line of 400 000 characters: all places of a token took the square of its length."""
    text = "of the " * 57_000 + "end"
    df = spark.createDataFrame([(text, "of the", 199_999), (text, "ofthe", 4), (text, "end", 0), (text, "OF", 10**6), ("aaaa", "aa", 2), ("abab", "ab", 1), ("x", "", 0), ("İ of the", "ofthe", 0)], "t string, k string, h int")
    got = [r.p and tuple(r.p) for r in df.select(N.token_in_span(F.col("t"), F.col("k"), F.col("h")).alias("p")).collect()]
    assert got[:7] == [(199_997, 200_003), (0, 6), (399_000, 399_003), (398_993, 398_995), (2, 4), (0, 2), (0, 0)]
