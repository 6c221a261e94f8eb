"""Rows that are kept as columns: a row is a dict that is made when it is asked for."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that are Python values at once.
SLICE = 1 << 16
#: Tasks that a large sort or count of small rows is cut into, at least, for each core.
TASKS_A_CORE = 16
#: Bytes after which no further file comes with an Arrow batch.
BATCH_BYTES = 8 << 20


def many_tasks(spark: SparkSession) -> int:
    """Tasks for an exchange of small rows: where they are put together until there are as many tasks as cores, because they take
    few bytes, each task holds a share of the whole."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def one_at_a_time(spark: SparkSession) -> None:
    """Files go to Python in batches of ``BATCH_BYTES``, so that a large one comes alone, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Free memory goes back to the system, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Columns(Sequence):
    """A sequence of ``length`` dicts. A column is an array, a list, or one value that all rows have; ``extra`` has more of some rows."""

    def __init__(self, length: int, extra: dict[int, dict] | None = None, **columns) -> None:
        self.length, self.extra, self.columns = length, extra or {}, columns

    def __len__(self) -> int:
        return self.length

    def part(self, name: str, a: int, b: int) -> list:
        """Rows ``a`` to ``b`` of a column as Python values."""
        c = self.columns[name]
        if isinstance(c, list):
            return c[a:b]
        return c[a:b].tolist() if hasattr(c, "tolist") else [c] * (min(b, self.length) - a)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(self.length))]
        k = range(self.length)[i]
        return {n: self.part(n, k, k + 1)[0] for n in self.columns} | self.extra.get(k, {})

    def __iter__(self) -> Iterator[dict]:
        for a in range(0, self.length, SLICE):
            for k, row in enumerate(zip(*(self.part(n, a, a + SLICE) for n in self.columns), strict=True), a):
                yield dict(zip(self.columns, row, strict=True)) | self.extra.get(k, {}) if self.extra else dict(zip(self.columns, row, strict=True))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Sequence) and list(self) == list(other)

    def array(self, name: str) -> np.ndarray:
        """A column as an array; floats for one that has no value."""
        c = self.columns[name]
        return np.asarray(c) if hasattr(c, "tolist") or isinstance(c, list) else np.full(self.length, np.nan if c is None else c)


def column(rows: Iterable[dict] | dict[str, np.ndarray], name: str, dtype=np.int64) -> np.ndarray:
    """A column of rows, which are dicts or columns already."""
    if isinstance(rows, dict):
        return rows[name]
    return np.fromiter((r[name] for r in rows), dtype=dtype)


def count(rows: Sequence[dict] | dict[str, np.ndarray]) -> int:
    return len(next(iter(rows.values()))) if isinstance(rows, dict) else len(rows)


def sums(values: np.ndarray) -> np.ndarray:
    """What stands before each value, and the sum of all behind them."""
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
