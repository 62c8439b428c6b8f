"""URL filters by a cascade of Bloom filters.

The key universe is complete: every (host suffix, path prefix) key that any url of the
corpus can ask for. Level 1 encodes the listed keys; level 2 the keys of the universe that
pass level 1 without being listed; level 3 the listed keys that pass level 2 too; and so on
until a level lets nothing wrong through. A key is looked up level by level, and the first
level that doesn't have it decides: absent from an odd level means not listed, absent from
an even one listed. Over the universe this is exact, so urls are judged without a join and
without the list; only the level filters, whose size follows the list and not the corpus,
are sent to the tasks.

Level 1 gets bits for a rate of false positives of at most ``rate``, later levels of 1/2.
Building reads the universe once (for the false positives of level 1, which are then
written and shrink level by level); bits are set by map-side bit_or, and a level of m bits
comes to the driver as m / 64 numbers. ``max_bits`` bounds a level; a list that needs more
is refused rather than judged wrongly.

A rule has a host and a path prefix; it fits a url whose host is the rule's or below it and
whose path starts with the rule's. The longest fitting rule (host and path together) wins;
an url that no rule fits gets ``default``. The wanted path prefixes of a url are those of
the lengths that listed paths have.

Results for odd input: null urls and urls without ``://`` have an empty host and path and
get the default; repeated rows get equal results; without rules everything gets the default.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parchment.llm.rows import with_made
from parchment.llm.storage import release, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BITS = 1 << 31
RATE = 0.001


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.substring_index(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), "#", 1), F.lit(""))
    rest = F.substring_index(rest, "?", 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise(F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """The keys that a url asks for, longest first: host suffixes at dots times path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths, reverse=True)))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    kept = F.filter(keys, lambda k: k.isNotNull())
    ordered = F.array_sort(F.transform(kept, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(ordered, lambda s: s["k"])))


def _hashes(key: Column, level: int) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(level)), F.xxhash64(key, F.lit(level), F.lit(1))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        for k in range(self.hashes):
            at = (a + np.uint64(k) * b) % np.uint64(self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _level(keys: DataFrame, n: int, rate: float, number: int, max_bits: int) -> Level:
    """A Bloom filter of the keys, its bits set by map-side bit_or."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    if bits > max_bits:
        raise ValueError(f"{n} keys need {bits} bits, over max_bits")
    hashes = max(1, round(bits / max(n, 1) * math.log(2))) if n else 1
    hashes = min(hashes, 16)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, h = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            at = np.concatenate([(a + np.uint64(k) * (h | np.uint64(1))) % np.uint64(bits) for k in range(hashes)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    h1, h2 = _hashes(F.col("key"), number)
    rows = keys.select(h1.alias("a"), h2.alias("b")).mapInArrow(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("v")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


class Cascade:
    """Exact membership over the universe that it was built for."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """hashes: (h1, h2) of the keys at each level."""
        n = len(hashes[0][0]) if hashes else 0
        out, open_ = np.zeros(n, bool), np.arange(n)
        for k, (level, (h1, h2)) in enumerate(zip(self.levels, hashes)):
            inside = level.has(h1[open_], h2[open_])
            out[open_[~inside]] = k % 2 == 1
            open_ = open_[inside]
        out[open_] = len(self.levels) % 2 == 1
        return out

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, rate: float = RATE, max_bits: int = MAX_BITS, max_levels: int = 40) -> Cascade:
        """listed, universe: (key). Keys of the list that the universe hasn't are encoded too."""
        yes = store(listed.select("key").filter("key is not null").distinct())
        n = yes.count()
        if not n:
            return Cascade([])
        levels = [_level(yes, n, rate, 1, max_bits)]
        no = store(_passing(universe.select("key").filter("key is not null").distinct(), levels[0], 1).join(yes, "key", "left_anti"))
        encode, other = no, yes
        while (n := encode.count()) and len(levels) < max_levels:
            number = len(levels) + 1
            levels.append(_level(encode, n, 0.5, number, max_bits))
            passing = store(_passing(other, levels[-1], number))
            release(other)
            encode, other = passing, encode
        if encode.count():
            raise ValueError("the cascade didn't end")
        return Cascade(levels)


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = sent.value.has(b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep))], names=["key"])

    h1, h2 = _hashes(F.col("key"), number)
    return keys.select("key", h1.alias("a"), h2.alias("b")).mapInArrow(run, "key string")


def universe(urls: DataFrame, path_lengths: list[int], url_col: str = "url") -> DataFrame:
    """(key): every key that a url of the corpus can ask for."""
    host, path = host_and_path(F.col(url_col))
    return urls.select(F.explode(url_keys(host, path, path_lengths)).alias("key")).distinct()


def build_filters(urls: DataFrame, rules: list[Rule], url_col: str = "url", **kw) -> tuple[dict[str, Cascade], list[int]]:
    """A cascade for each action, over the keys of all urls, and the lengths of listed paths."""
    spark = urls.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    keys = store(universe(urls, lengths, url_col))
    out = {}
    for action in sorted({r.action for r in rules}):
        listed = spark.createDataFrame([(r.key,) for r in rules if r.action == action], "key string")
        out[action] = Cascade.build(listed, keys, **kw)
    release(keys)
    return out, lengths


def judge(urls: DataFrame, filters: dict[str, Cascade], path_lengths: list[int], url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (the key of the longest fitting rule, else null) and verdict."""
    spark: SparkSession = urls.sparkSession
    host, path = host_and_path(F.col(url_col))
    df = urls.withColumn("host", host).withColumn("path", path)
    depth = max((len(c.levels) for c in filters.values()), default=0)
    if not depth:
        return df.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    sent = spark.sparkContext.broadcast(filters)
    keys = url_keys(F.col("host"), F.col("path"), path_lengths)
    hashes = F.transform(keys, lambda k: F.array(*(h for n in range(1, depth + 1) for h in _hashes(k, n))))

    def judge_task():
        names = sorted(sent.value)

        def first(b: pa.Array) -> list[pa.Array]:
            sizes = np.diff(b.offsets.to_numpy())
            flat = b.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * depth)
            pairs = [(np.ascontiguousarray(flat[:, 2 * k]), np.ascontiguousarray(flat[:, 2 * k + 1])) for k in range(depth)]
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            best = np.full(len(sizes), np.iinfo(np.int64).max)
            for a, name in enumerate(names):  # the list is longest first: the smallest place wins
                found = np.flatnonzero(sent.value[name].has(pairs))
                np.minimum.at(best, row[found], place[found] * len(names) + a)
            return [pa.array(np.where(best == np.iinfo(np.int64).max, -1, best), pa.int64())]

        return first

    names = F.array(*(F.lit(n) for n in sorted(filters)))
    df = with_made(df.withColumn("__keys", keys), [hashes], [("__at", "bigint")], judge_task)
    fits = F.col("__at") >= 0
    rule = F.when(fits, F.get("__keys", (F.col("__at") / len(filters)).cast("int")))
    verdict = F.when(fits, F.get(names, (F.col("__at") % len(filters)).cast("int"))).otherwise(F.lit(default))
    return df.withColumn("rule", rule).withColumn("verdict", verdict).drop("__keys", "__at")


def filter_urls(urls: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", **kw) -> DataFrame:
    """All urls, judged; the columns host, path, rule and verdict replace any of those names."""
    filters, lengths = build_filters(urls, rules, url_col, **kw)
    return judge(urls, filters, lengths, url_col, default)
