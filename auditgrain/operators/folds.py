"""Ordered folds: what one row decides depends on the rows before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: (state, or None at the first row of a key, and the values read) -> (state, values of the added columns)
Step = Callable[..., tuple[Any, tuple]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], reads: Sequence[str], adds: Mapping[str, str], step: Step) -> DataFrame:
    """`df` with the columns `adds` (long or string), each row judged with a state that its key's earlier rows left.

    Rows are dealt by key and sorted there; a task streams them and holds one state, never a key's rows
    together, however many there are. Judging a key is sequential by nature and stays in one task.
    """
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = df.columns
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {k}" for n, k in adds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            columns = {n: batch.column(names.index(n)).to_pylist() for n in {*keys, *reads}}
            added: list[tuple] = []
            for key, values in zip(zip(*(columns[k] for k in keys), strict=True), zip(*(columns[r] for r in reads), strict=True), strict=True):
                if key != at:
                    at, state = key, None
                state, new = step(state, *values)
                added.append(new)
            made = zip(*added, strict=True) if added else [()] * len(adds)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in range(len(names))), *(pa.array(list(c), kinds[k]) for c, k in zip(made, adds.values(), strict=True))],
                names=[*names, *adds],
            )

    return ordered.mapInArrow(run, schema)

