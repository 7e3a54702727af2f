"""Functions of the user over groups: table functions that see a group's rows in order, and aggregates with partial states.

Both keep to bounded memory: a table function is handed one row at a time, and an aggregate's states are made and merged in each task
before anything is shuffled, so a hot group is as many states as there are tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: States that a task holds before it hands them on.
STATES = 10_000


def table_function(df: DataFrame, start: Callable[[], Any], step: Callable[[Any, Row], Iterator[tuple] | None], finish: Callable[[Any], Iterator[tuple]], schema: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows of ``schema`` that a function makes of each group of df, whose rows it gets in the order of ``order``.

    start() makes a group's state, step(state, row) changes it in place and may yield rows, finish(state) yields the last ones.  It runs as a
    Python table function with a partitioned table argument, so rows are streamed and never gathered.
    """

    class Function:
        def __init__(self):
            self.state = start()

        def eval(self, row: Row):
            yield from step(self.state, row) or ()

        def terminate(self):
            yield from finish(self.state) or ()

    argument = df.asTable().partitionBy(*by)
    return F.udtf(Function, returnType=schema)(argument.orderBy(*order) if order else argument)


def aggregate_function(df: DataFrame, by: list[str], columns: list[str], start: Callable[[], Any], update: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], tuple], schema: str) -> DataFrame:
    """(by, <schema>): an aggregate of the columns for each group of df, in partial, merge and finish steps.

    update(state, rows) takes in the rows of a group that a batch holds, merge(a, b) joins two states, finish(state) gives the values of ``schema``.
    States must not depend on the order of rows and merges.  They travel pickled; what a task merges is its own groups' states only.
    """
    keys = [df.schema[c] for c in by]
    names = [*by, *columns]
    at = f"_n{uuid.uuid4().hex[:8]}"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*states, strict=True)) if by else []
            arrays = [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)] + [pa.array([cloudpickle.dumps(s) for s in states.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, [*by, "state"])

        types: list[pa.DataType] = []
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(c).type for c in by]
            t = pa.Table.from_batches([b]).append_column(at, pa.array(range(b.num_rows), pa.int64()))
            groups = t.group_by(by).aggregate([(at, "list")]) if by else None
            found = zip(zip(*(groups.column(c).to_pylist() for c in by), strict=True), groups.column(f"{at}_list"), strict=True) if by else [((), None)]
            for key, rows in found:
                part = b.select(columns) if rows is None else b.select(columns).take(rows.values)
                states[key] = update(states[key] if key in states else start(), part)
            if len(states) > STATES:
                yield out()
                states.clear()
        if states:
            yield out()

    def close(t: pa.Table) -> pa.Table:
        state = None
        for i, s in enumerate(t.column("state")):
            s = cloudpickle.loads(s.as_py())
            state = s if i == 0 else merge(state, s)
        values = finish(state)
        head = [t.column(c).slice(0, 1).combine_chunks() for c in by]
        return pa.Table.from_arrays([*head, *(pa.array([v]) for v in values)], names=[*by, *fields])

    key_ddl = [f"`{k.name}` {k.dataType.simpleString()}" for k in keys]
    fields = [x.strip().split()[0] for x in schema.split(",")]
    states = df.select(*names).mapInArrow(partial, ", ".join([*key_ddl, "state binary"]))
    grouped = states.groupBy(*by) if by else states.groupBy(F.lit(0).alias("_all"))
    return grouped.applyInArrow(close, ", ".join([*key_ddl, schema]))
