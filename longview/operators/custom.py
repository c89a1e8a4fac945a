"""A user's own group functions: aggregates and table functions with mergeable states.

A function describes a state, how rows become states, how states merge and what comes out. Rows become states in the
task that reads them, a batch at a time over all groups in it, and only states are shuffled: a group that holds most of
the rows sends one state a task, and is merged, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from longview.operators.common import attach

#: Groups whose states a task holds before it passes them on.
HELD_GROUPS = 200_000


class GroupFunction:
    """Override the schemas and the three steps; each step works on a frame of many groups at once.

    ``update`` and ``merge`` return one row per value of the key columns ``by`` (use ``grouped``), ``finish`` any number
    of rows per group: one for an aggregate, several for a table function. Merging must not depend on order.
    """

    #: Columns of the state and of the result, as ``name type, ...``.
    state: str
    result: str

    def update(self, rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        raise NotImplementedError

    def merge(self, states: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        raise NotImplementedError

    def finish(self, states: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        raise NotImplementedError


def grouped(rows: pd.DataFrame, by: list[str]):
    """The groups of a frame; a missing key is a key, and without keys all rows are one group."""
    return rows.groupby(by or (lambda _: 0), dropna=False, sort=False)


_USER: dict[str, GroupFunction] = {}


def register(name: str, function: GroupFunction) -> None:
    """Make an aggregate known to views by a name for ``y_agg``; its result has one column."""
    if "," in function.result:
        raise ValueError("an aggregate of a view has one result column")
    _USER[name] = function


def registered(name: str | None) -> GroupFunction | None:
    return _USER.get(name)


def _fields(ddl: str) -> list[T.StructField]:
    return T._parse_datatype_string(ddl).fields


def _frame(batch: pa.RecordBatch, by: list[str]) -> pd.DataFrame:
    """A batch as a frame whose keys keep their exact values: nulls stay nulls, long integers whole."""
    rest = [n for n in batch.schema.names if n not in by]
    keys = {k: pd.Series(batch.column(k), dtype=pd.ArrowDtype(batch.schema.field(k).type)) for k in by}
    return pd.concat([pd.DataFrame(keys), batch.select(rest).to_pandas()], axis=1) if by else batch.select(rest).to_pandas()


def _flat(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return frame.reset_index() if by else frame.reset_index(drop=True)


def group_function(df: DataFrame, by: list[str], inputs: list[str], function: GroupFunction) -> DataFrame:
    """The rows of ``function`` for each group of ``by``, beside the keys."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [df.schema[k] for k in by]
    states = T.StructType([*kinds, *_fields(function.state)])
    results = T.StructType([*kinds, *_fields(function.result)])
    names = states.names
    state_schema, result_schema = to_arrow_schema(states), to_arrow_schema(results)

    def batches_of(frame: pd.DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_pandas(frame[schema.names], schema=schema, preserve_index=False).to_batches():
            yield b

    def partial(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _flat(function.update(_frame(batch, by), by), by)[names]
            held = new if held is None else _flat(function.merge(pd.concat([held, new], ignore_index=True), by), by)[names]
            if len(held) > HELD_GROUPS:
                yield from batches_of(held, state_schema)
                held = None
        if held is not None:
            yield from batches_of(held, state_schema)

    def whole(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _frame(batch, by)
            new = new if held is None else pd.concat([held, new], ignore_index=True)
            held = _flat(function.merge(new, by), by)[names]
        if held is not None:
            yield from batches_of(function.finish(held, by), result_schema)

    sent = df.select(*by, *[c for c in inputs if c not in by]).mapInArrow(partial, states)
    together = sent.repartition(*by) if by else sent.repartition(1)
    return together.mapInArrow(whole, results)


def with_group_result(df: DataFrame, by: list[str], inputs: list[str], function: GroupFunction) -> DataFrame:
    """Every row with the result of its group beside it: the way for functions that return as many rows as they get."""
    return attach(df, by, group_function(df, by, inputs, function), [f.name for f in _fields(function.result)])
