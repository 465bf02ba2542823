"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32()}


def over_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str) -> DataFrame:
    """`make` gives the columns of the output for each batch of `df`; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None:
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return df.mapInArrow(run, schema)


PART = 4_096


def merged_array(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, merge: np.ufunc = np.add, dtype: type = np.int64, *, apart: bool = False) -> np.ndarray:
    """One array of `size` numbers, merged from the arrays that `fill` makes of the tasks' batches.

    Arrays travel in parts of fixed length and are merged part by part as they come, so that no task
    holds more than its own share, and the driver gets `size` numbers whatever the data. `apart` says
    that no two tasks have rows of the same part, so there is nothing to merge."""

    def give(parts: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array(which), "value": pa.array([parts[k].tobytes() for k in range(len(which))], pa.binary())})

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // PART) * PART, dtype)
        for batch in batches:
            if batch.num_rows:
                fill(total[:size], batch)
        parts = total.reshape(-1, PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield give(parts[some], some)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                now = np.frombuffer(value.as_buffer(), dtype)
                held[part] = merge(held[part], now) if part in held else now
        if held:
            yield give(np.stack(list(held.values())), np.array(list(held), np.int64))

    out = np.zeros(-(-size // PART) * PART, dtype)
    parts = df.mapInArrow(collect, "part long, value binary")
    for row in (parts if apart else parts.repartition("part").mapInArrow(join, "part long, value binary")).collect():
        out[row.part * PART : (row.part + 1) * PART] = np.frombuffer(row.value, dtype)
    return out[:size]


def bucket_counts(df: DataFrame, buckets: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """How many entries of all rows of `df` fall into each of `size` buckets."""

    def fill(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total += np.bincount(buckets(batch), minlength=size)

    return merged_array(df, fill, size)


def bounded_sample(df: DataFrame, by: str, size: int) -> DataFrame:
    """The `size` rows of `df` of least hash of column `by`, ties by the row itself.

    Rows are first thinned by a threshold on the hash that leaves about twice as many as asked for, so
    that what tasks send to be ordered is bounded by `size` and not by the number of tasks."""
    total = df.count()
    h = F.xxhash64(by)
    keep = min(1.0, (2 * size + 100) / max(total, 1))
    thin = df.where(h <= F.lit(int(-(2**63) + keep * (2**64 - 1)) if keep < 1 else 2**63 - 1))
    return thin.orderBy(h, *df.columns).limit(size)
