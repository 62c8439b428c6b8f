"""Sequential folds over a key's rows in order, for rules in which a row's outcome changes what later rows meet.

Rows are dealt by key and sorted, and stream through one state a key: nothing of a key but its state is
held, so a key of any number of rows is folded in bounded memory and linear time. Which task a key's rows run in
follows the key alone; rules that need no earlier outcome don't belong here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: (state or None at a key's first row, *inputs) -> (state, made values)
Step = Callable[..., tuple]


def fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], made: dict[str, str], step: Step) -> DataFrame:
    """rows with the columns ``made`` (name: type), which ``step`` gives row by row in the order of each key.

    Ties of ``order`` are the caller's to exclude. Null keys are one key; columns named in ``made`` are replaced.
    """
    rest = [c for c in rows.columns if c not in made]
    names = [*rest, *(c for c in inputs if c not in rest)]
    plain = rows.select(*(F.col(f"`{c}`") for c in names))
    dealt = plain.repartition(*(F.col(f"`{k}`") for k in keys)).sortWithinPartitions(*(F.col(f"`{k}`") for k in [*keys, *order]))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{c}` {t}" for c, t in made.items())])
    arrow = {c: {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[t] for c, t in made.items()}
    at, own = [names.index(k) for k in keys], [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            out = []
            key_rows = zip(*(b.column(k).to_pylist() for k in at))
            for key, values in zip(key_rows, zip(*(b.column(k).to_pylist() for k in own))):
                if key != last:
                    last, state = key, None
                state, result = step(state, *values)
                out.append(result)
            cols = list(zip(*out)) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(v, t) for v, t in zip(cols, arrow.values()))], names=[*rest, *made])

    return dealt.mapInArrow(run, schema)


def throttle_step(window_ms: int, most: int) -> Step:
    """State: (start of the window, requests in it). A window starts with the first request after the last one ran out."""

    def step(state, ms):
        start, n = state if state is not None and ms < state[0] + window_ms else (ms, 0)
        n += 1
        return (start, n), (n > most, start + window_ms - ms if n > most else 0)

    return step


def quota_step(used, chars, limit):
    """State: what is used. A request that would pass the limit is denied and costs nothing."""
    used = used or 0
    fits = used + chars <= limit
    used += chars if fits else 0
    return used, (fits, used)


def open_quota_step(used, outcome, chars, limit, name):
    """The same for requests that nothing has decided yet; others pass by and cost nothing."""
    used = used or 0
    if outcome is None and used + chars > limit:
        return used, (name,)
    return used + (chars if outcome is None else 0), (outcome,)
