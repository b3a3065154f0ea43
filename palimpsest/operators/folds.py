"""Ordered folds of each key's rows, streamed: a task holds one Arrow batch and one state, whatever the key's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def fold_sorted(rows: DataFrame, by: list[str], values: dict[str, Column], begin: Any, step: Callable, out: dict[str, str], each: bool = True) -> DataFrame:
    """``by`` and ``out`` (name -> long, double or boolean) of every row, or with ``each`` false of every key's last state.

    step(state, values) -> (state, row of ``out``); rows come sorted by ``by``, then by the
    values in their order.  The shuffle is one on the key and the sort may spill; rows of one
    key follow each other in one task, as a fold that is not associative asks.  Null keys are
    a key of their own.
    """
    n, types = len(by), [ARROW[t] for t in out.values()]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + [f"`{c}` {t}" for c, t in out.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, keys = None, begin, None

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), keys + types)], names=[*by, *out])

        for batch in batches:
            keys = [f.type for f in list(batch.schema)[:n]]
            columns, made = [c.to_pylist() for c in batch.columns], []
            for k, v in zip(zip(*columns[:n]), zip(*columns[n:])):
                if k != key:
                    if not each and key is not None:
                        made.append((*key, state))
                    key, state = k, begin
                state, row = step(state, v)
                if each:
                    made.append((*k, *row))
            if made:
                yield batch_of(made)
        if not each and key is not None:
            yield batch_of([(*key, state)])

    names = [f"_{i}" for i in range(len(values))]
    dealt = rows.select(*by, *(c.alias(a) for a, c in zip(names, values.values()))).repartition(*by)
    return dealt.sortWithinPartitions(*by, *names).mapInArrow(run, ", ".join(kinds))
