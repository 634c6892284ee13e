"""Windows along groups of any size: neighbours and running totals across the ranges of a total order.

Ranges are cut along (keys, order), so a group that lies in several ranges crosses a border: there
are fewer such groups than ranges, and only they need rows or totals from elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.ranges import in_ranges
from tessera.plans.workspace import materialise

RANGE, HALO = "__range", "__halo"


def _other(keys: Sequence[str]) -> tuple[list[Column], Column, list[str]]:
    """Keys under other names, the null-safe equality with them, and those names."""
    names = [f"__of_{i}" for i in range(len(keys))]
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], same, names


class Along:
    """``df``, written once in ranges along (keys, order); a row's range is in ``RANGE``. Null keys are a group."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], per_range: int = 1_000_000, ranges: int | None = None):
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        self.rows = in_ranges(df, [*keys, *order], RANGE, per_range, ranges)
        renamed, self._same, self._names = _other(self.keys)
        ends = self.rows.groupBy(*keys).agg(F.min(RANGE).alias("__lo"), F.max(RANGE).alias("__hi")).where("__lo < __hi")
        self._groups = materialise(ends.select(*renamed), "crossing")  # written, so the planner knows how few they are

    def _crossing(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose group lies in more than one range."""
        return df.join(self._groups, self._same, "left_semi")

    def neighbours(self, before: int, after: int) -> DataFrame:
        """The rows, with copies of up to ``before`` from in front of each range and ``after`` from behind it.

        A window by (keys, ``RANGE``) in that order which looks no further is right on the rows whose ``HALO`` is
        false; the others are the copies. Where a range holds fewer rows of a group than asked for, those further away
        come too. ``before`` and ``after`` are small: a border carries an array of so many rows.
        """
        row = F.struct(*[F.col(f"`{c}`") for c in self.columns])
        placed = self._crossing(self.rows).select(*self.keys, RANGE, row.alias("__row"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(self.order)])
        inside = Window.partitionBy(*self.keys, RANGE).orderBy(*[f"__o{i}" for i in range(len(self.order))])
        edge = lambda shift, n: shift(F.lit(1), n).over(inside).isNull() if n else F.lit(False)
        placed = placed.select(*self.keys, RANGE, "__row", F.row_number().over(inside).alias("__i"), edge(F.lag, after).alias("__first"), edge(F.lead, before).alias("__last")).where("__first or __last")
        item = F.struct("__i", "__row")
        listed = lambda which: F.array_sort(F.collect_list(F.when(F.col(which), item)), lambda a, b: a["__i"] - b["__i"])
        borders = placed.groupBy(*self.keys, RANGE).agg(listed("__first").alias("__first"), listed("__last").alias("__last"))
        across, copies = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(RANGE), []
        if before:
            ahead = F.flatten(F.collect_list("__last").over(across.rowsBetween(-before, -1)))
            copies.append(F.when(F.size(ahead) > before, F.slice(ahead, -before, before)).otherwise(ahead))
        if after:
            copies.append(F.slice(F.flatten(F.collect_list("__first").over(across.rowsBetween(1, after))), 1, after))
        borders = borders.select(RANGE, F.concat(*copies).alias("__copies"))
        halo = borders.select(RANGE, F.explode("__copies").alias("__copy")).select("__copy.__row.*", RANGE, F.lit(True).alias(HALO))
        return self.rows.withColumn(HALO, F.lit(False)).unionByName(halo)

    def carried(self, df: DataFrame, totals: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
        """``df``, which is these rows with more columns or some of them, with the merged aggregate of its group's earlier ranges for each name; null where there is none.

        ``totals`` gives an aggregate and the aggregate that merges it (a count and a sum, a maximum and a maximum).
        """
        renamed, same, names = _other(self.keys)
        sums = self._crossing(df).groupBy(*self.keys, RANGE).agg(*[total.alias(name) for name, (total, _) in totals.items()])
        upto = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(*renamed, F.col(RANGE).alias("__in"), *[merge(name).over(upto).alias(name) for name, (_, merge) in totals.items()])
        return df.join(starts, same & (F.col(RANGE) == F.col("__in")), "left").drop("__in", *names)
