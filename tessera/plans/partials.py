"""Sums of arrays over all rows: one array a partition and key, then a tree of partial sums."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a partition's batches to one array for each key (a string) that occurs in them.
Kernel = Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[str, np.ndarray]]]
#: Two arrays of a key to one, in any order of merging.
Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]
_ROW = "name string, part int, total binary"


def _batch(name: str, part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name]), pa.array([part], pa.int32()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["name", "part", "total"])


def _first(batches: Iterator[pa.RecordBatch], kernel: Kernel, fan: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    for name, total in kernel(batches):
        yield _batch(name, (task.partitionId() if task else 0) % fan, total)


def _merged(batches: Iterator[pa.RecordBatch], merge: Merge) -> Iterator[pa.RecordBatch]:
    """Merge the arrays of each (name, part) of a partition; they are of a fixed size, so as many are held as there are keys."""
    known: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for name, part, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = np.frombuffer(total, np.float64)
            known[name, part] = merge(known[name, part], value) if (name, part) in known else value
    for (name, part), total in known.items():
        yield _batch(name, part, total)


def array_sums(rows: DataFrame, kernel: Kernel, merge: Merge = np.add, fan: int = 64, partitions: int | None = None) -> dict[str, np.ndarray]:
    """For each key that ``kernel`` names the merged array of all partitions (how many ``rows`` has, if that is known).

    Each partition is read once and leaves one array a key. Those of a key meet in ``fan`` groups, the groups' in one
    task; so no task merges more than a ``fan``-th of all partitions, and the driver receives one array a key.
    Empty in, empty out.
    """
    total = rows.mapInArrow(functools.partial(_first, kernel=kernel, fan=fan), _ROW)
    if (partitions or rows.rdd.getNumPartitions()) > fan:
        total = total.repartition("name", "part").mapInArrow(functools.partial(_merged, merge=merge), _ROW)
    total = total.withColumn("part", F.lit(0)).repartition("name").mapInArrow(functools.partial(_merged, merge=merge), _ROW)
    return {r.name: np.frombuffer(bytes(r.total), np.float64) for r in total.collect()}  # a row a key
