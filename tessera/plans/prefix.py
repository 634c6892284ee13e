"""Running totals over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    ties: Sequence[str],
    value: Column,
    out: str,
    bins: int = 256,
) -> DataFrame:
    """Exclusive running total of ``value`` in each group of ``keys``.

    Rows stand in the order (``order`` modulo ``bins``, ``order``, ``ties``);
    ``order`` must be an evenly spread bigint such as a hash. A group's total is
    first taken per bin (partial aggregation does most of it), the few bin totals
    are summed up, and only then are rows sorted, each bin on its own. A group
    that holds a third of all rows is thus dealt to ``bins`` tasks. Null totals
    count as 0; keys compare null-safe through ``groupBy`` and ``<=>``.
    """
    tagged = df.select("*", F.pmod(order, F.lit(bins)).cast("int").alias("__bin"), order.alias("__ord"), value.cast("bigint").alias("__val"))
    sums = tagged.groupBy(*keys, "__bin").agg(F.coalesce(F.sum("__val"), F.lit(0)).alias("__sum"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bin").alias("__b"), F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__start"))
    same = F.col("__bin") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys, "__bin").orderBy("__ord", *ties).rowsBetween(Window.unboundedPreceding, -1)
    dealt = tagged.repartition(*keys, "__bin")  # rows that already lie by ``keys`` would otherwise stay there, whole groups in a task
    ranked = dealt.withColumn("__before", F.coalesce(F.sum("__val").over(inside), F.lit(0)))
    joined = ranked.join(starts, same, "inner").withColumn(out, F.col("__start") + F.col("__before"))
    return joined.drop("__bin", "__ord", "__val", "__before", "__start", "__b", *[f"__k_{k}" for k in keys])
