"""Columns made batch by batch in Python, beside all the columns that a table has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def col(name: str) -> Column:
    """The column of that very name, whatever stands in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., which no name of a step's own can meet, and {name: number}."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.select(*(col(c).alias(n) for c, n in names.items())), names


def restored(df: DataFrame, names: dict[str, str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of before under their names; ``new`` replaces those of its names and adds the others."""
    new = new or {}
    return df.select(*((new[c] if c in new else F.col(n)).alias(c) for c, n in names.items()), *(e.alias(c) for c, e in new.items() if c not in names))


def with_made(df: DataFrame, inputs: list[Column], made: list[tuple[str, str]], f: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """df with the columns ``made`` (name, type), which replace any of those names.

    f() gives, once a task, the function from the input arrays of a batch to the made arrays.
    Columns are numbered on the way, so that no name can clash.
    """
    names = {n for n, _ in made}
    kept = [c for c in df.columns if c not in names]
    k = len(kept)
    plain = df.select(*(F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(kept)), *(c.alias(str(k + i)) for i, c in enumerate(inputs)))
    schema = ", ".join([*(f"`{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), *(f"`{k + i}` {t}" for i, (_, t) in enumerate(made))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = f()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *make(*b.columns[k:])], names=[str(i) for i in range(k + len(made))])

    out = plain.mapInArrow(run, schema)
    place = {c: str(i) for i, c in enumerate([*kept, *(n for n, _ in made)])}
    order = [*df.columns, *(n for n, _ in made if n not in df.columns)]
    return out.select(*(F.col(place[c]).alias(c) for c in order))


def one_of_each(docs: DataFrame, key: list[Column], gone: DataFrame, twice: DataFrame, order: list[Column]) -> DataFrame:
    """docs without the rows whose key is in ``gone``, and of those whose key is in ``twice`` the first by ``order`` only.

    Keys may be null and may repeat; no other row is touched, whatever id it shares. Only rows
    with a key in ``twice`` are ordered, so the texts of all others stay where they are read.
    """
    rows, names = numbered(docs)
    marks = [f"k{i}" for i in range(len(key))]
    own = docs.select(*(col(c).alias(n) for c, n in names.items()), *(k.alias(m) for k, m in zip(key, marks)))

    def meets(other: DataFrame) -> tuple[DataFrame, Column]:
        other = other.toDF(*(f"o{i}" for i in range(len(key))))
        on = [own[m].eqNullSafe(other[f"o{i}"]) for i, m in enumerate(marks)]
        return other, reduce(lambda a, b: a & b, on)

    out = own.join(*meets(gone.unionAll(twice)), "left_anti").select(*names.values())
    if not twice.isEmpty():
        again = docs.select(*(col(c).alias(n) for c, n in names.items()), *(k.alias(m) for k, m in zip(key, marks)), *(o.alias(f"s{i}") for i, o in enumerate(order)))
        other = twice.toDF(*(f"o{i}" for i in range(len(key))))
        again = again.join(other, reduce(lambda a, b: a & b, [again[m].eqNullSafe(other[f"o{i}"]) for i, m in enumerate(marks)]), "left_semi")
        first = Window.partitionBy(*marks).orderBy(*(F.col(f"s{i}") for i in range(len(order))), *marks)
        out = out.unionAll(again.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*names.values()))
    return restored(out, names)
