"""What the two operators on integer vectors share: exact integers of components, and sums that tasks add up first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No integer of a component is larger than this, either way.
MOST = 1 << 53


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), not beyond MOST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of integers, as Python's own."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return (x if most * max(1, len(x)) < 1 << 63 else x.astype(object)).sum(axis=0).astype(object)


def long(x: int) -> int:
    """The nearest 64-bit number."""
    return min(max(int(x), -(1 << 63)), (1 << 63) - 1)


def sizes(rows: DataFrame, column: str) -> list[int]:
    """The lengths that vectors have; commonly one."""
    return sorted(r[0] for r in rows.select(F.size(column)).distinct().collect())


def sums(rows: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], n: int, exact: bool = False) -> np.ndarray:
    """The sum of work(batch), n numbers, over all batches of rows: doubles or, if exact, Python's integers.

    A task adds up its batches and sends n rows, so that what is shuffled is n numbers a task and what comes to the driver
    is n numbers, however many rows there are.
    """
    kind = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = work(b) if total is None else total + work(b)
        if total is not None:
            values = [Decimal(int(v)) for v in total] if exact else total
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(values, kind)], ["at", "value"])

    made = rows.mapInArrow(run, f"at int, value {'decimal(38,0)' if exact else 'double'}").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(n, object if exact else np.float64)
    for r in made.collect():
        out[r["at"]] = int(r["value"]) if exact else r["value"]
    return out
