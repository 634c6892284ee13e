"""Samples of a bounded size, drawn by hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from all 64 bits of the columns' hash."""
    return F.xxhash64(F.lit(seed), *columns).cast("double") / 2.0**64 + 0.5


def bounded_sample(df: DataFrame, group: str, counts: Mapping, columns: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of every group at the most, those with the smallest hash of ``columns``.

    ``counts`` has each group's number of rows. A rate somewhat above n / count thins
    the rows out before the few that are left are ranked, so no group is gathered in one task, and
    rows that repeat cannot make the sample grow. The same table gives the same sample.
    """
    if not counts:
        return df.limit(0)
    rate = F.element_at(F.create_map(*[F.lit(x) for key, count in counts.items() for x in (key, min(1.0, (1.2 * n + 50) / max(1, count)))]), F.col(group))
    thin = df.withColumn("__unit", unit_hash(seed, *columns)).where(F.col("__unit") < rate)
    ranked = thin.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy("__unit", *columns)))
    return ranked.where(F.col("__rank") <= n).drop("__unit", "__rank")
