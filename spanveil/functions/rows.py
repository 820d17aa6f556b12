"""Python functions on single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of results, about, that a worker gathers before it hands them on.
HANDED = 4 * 2**20


def _weight(x) -> int:
    if isinstance(x, str | bytes):
        return len(x)
    return sum(map(_weight, x)) if isinstance(x, tuple | list) else x.nbytes if isinstance(x, pa.Array) else 8


def by_row(kind: str, one: Callable) -> Callable[..., Column]:
    """A column function of `one`, which takes the Arrow scalars of a row and gives a Python value, or an Arrow array of one.

    A worker holds what Spark sends it at a time (spark.sql.execution.arrow.maxBytesPerBatch),
    what `one` makes of a single row, and results of HANDED bytes, however many rows there are.
    """
    made = to_arrow_type(DataType.fromDDL(kind))

    def joined(done: list) -> pa.Array:
        return pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array([x], made) for x in done]) if any(isinstance(x, pa.Array) for x in done) else pa.array(done, made)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            done, size = [], 0
            for row in zip(*(columns if isinstance(columns, tuple) else (columns,)), strict=True):
                done.append(one(*row))
                size += _weight(done[-1])
                if size > HANDED:
                    yield joined(done)
                    done, size = [], 0
            if done:
                yield joined(done)

    return F.arrow_udf(run, kind)
