"""Aggregates given by the user: partial states are made where the rows are, merged by key and finished."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys that a task gathers before it sends their states on.
MOST_KEYS = 100_000


@dataclass
class Aggregate:
    """``partial`` makes a state of some rows' columns (a dictionary of arrays), ``merge`` one of two, ``finish`` the result's
    values in the order of ``schema``. A state should not grow with the rows; it travels pickled.
    """

    columns: list[str]
    partial: Callable[[dict[str, np.ndarray]], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]
    schema: str


REGISTERED: dict[str, Aggregate] = {}


def register(name: str, aggregate: Aggregate) -> None:
    """Make an aggregate known by a name; one that is taken raises."""
    if name in REGISTERED:
        raise ValueError(f"an aggregate of the name {name} is registered already")
    REGISTERED[name] = aggregate


def aggregate_by(df: DataFrame, keys: list[str], how: str | Aggregate) -> DataFrame:
    """The keys and the aggregate's result for each group.

    Cases: rows with a null in a column that is aggregated don't count; a group of such rows alone has no row; a null key is
    a group; an empty table gives an empty table. A hot key sends one state from each task.
    """
    a = REGISTERED[how] if isinstance(how, str) else how
    rows = df.select(*keys, *[df[c].alias(f"__{k}") for k, c in enumerate(a.columns)]).dropna(subset=[f"__{k}" for k in range(len(a.columns))])
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def states(batches):
        held: dict[tuple, Any] = {}
        types = None

        def out():
            columns = list(zip(*held)) if held else [()] * len(keys)
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, types)), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], names=[*keys, "state"])

        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            table = b.select(keys).to_pylist()
            _, first, group = np.unique([repr(tuple(r.values())) for r in table], return_index=True, return_inverse=True) if b.num_rows else (None, [], [])
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(np.asarray(group)[order], np.arange(len(first) + 1))
            values = {c: b.column(len(keys) + k).to_numpy(zero_copy_only=False)[order] for k, c in enumerate(a.columns)}
            for g, at in enumerate(first):
                key, part = tuple(table[at].values()), a.partial({c: v[cuts[g] : cuts[g + 1]] for c, v in values.items()})
                held[key] = a.merge(held[key], part) if key in held else part
            if len(held) >= MOST_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    def finished(key, part):
        state = None
        for s in part.column("state").to_pylist():
            state = pickle.loads(s) if state is None else a.merge(state, pickle.loads(s))
        values = a.finish(state)
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([v]) for v in values)], names=[*keys, *[x.split()[0] for x in a.schema.split(", ")]])

    return rows.mapInArrow(states, f"{kinds}, state binary").groupBy(*keys).applyInArrow(finished, f"{kinds}, {a.schema}")
