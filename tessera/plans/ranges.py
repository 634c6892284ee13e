"""Ranges of a total order, as many as the rows ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import materialise


def in_ranges(df: DataFrame, order: Sequence[Column | str], out: str, per_range: int = 1_000_000, ranges: int | None = None) -> DataFrame:
    """``df``, written once, with the number of the range of ``order`` that a row falls in as ``out``.

    Spark samples the order and cuts it where its rows are, so a narrow group that stands first in
    ``order`` has cuts of its own. There are about ``per_range`` rows in each, and at
    least as many ranges as the session shuffles to; equal rows share one. Numbers are written down with the rows, for
    another pass over the source could draw other cuts.
    """
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // per_range))
    return materialise(df.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id()), "ranges")


def totals_before(df: DataFrame, keys: Sequence[str], range_: str, totals: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the total of an aggregate over the ranges of the row's group before its own, 0 for the first.

    A row a (group, range) is summed up in order; null keys are a group.
    """
    sums = df.groupBy(*keys, range_).agg(*[total.alias(name) for name, total in totals.items()])
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {k: f"__of_{k}" for k in (*keys, range_)}
    starts = sums.select(*[F.col(k).alias(n) for k, n in renamed.items()], *[F.coalesce(F.sum(name).over(upto), F.lit(0)).alias(name) for name in totals])
    same = F.lit(True)
    for k, n in renamed.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(starts, same).drop(*renamed.values())
