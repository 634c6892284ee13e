"""Joins with the guarantees that the event data needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import in_ranges, totals_before


class DuplicateKeys(ValueError):
    """A side of a one-to-one join repeats a key."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K7: the keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], side: str = "side") -> DataFrame:
    """``df``, once no key repeats; DuplicateKeys otherwise."""
    found = duplicate_keys(df, keys).limit(3).collect()
    if found:
        raise DuplicateKeys(f"{side} repeats {[tuple(r) for r in found]}")
    return df


def fuse_left(events: DataFrame, *features: tuple[DataFrame, Sequence[str]], key: str = "event_id", checked: bool = True) -> DataFrame:
    """All events; of each feature table only the listed columns, null without a match.

    The feature tables' keys must be unique, else rows would multiply.
    """
    for table, columns in features:
        side = table.select(key, *columns)
        events = events.drop(*[c for c in columns if c in events.columns]).join(require_unique(side, [key], "features") if checked else side, key, "left")
    return events


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join whose keys are unique on both sides."""
    return require_unique(left, keys, "left").join(require_unique(right, keys, "right"), list(keys))


def known_only(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is known."""
    return df.join(known, list(keys), "left_semi")


def unknown_only(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not known."""
    return df.join(known, list(keys), "left_anti")


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column], key: str) -> DataFrame:
    """K-th row with k-th row; (ordinal, left_key, right_key, agrees).

    Ordinals come from range-sorted bins: rows are ranked in their bin and shifted by
    the rows of the bins before, so the order is total and no task has all rows.
    """
    a = sorted_ordinal(left, left_order[0], left_order[1:]).select("ordinal", F.col(key).alias("left_key"))
    b = sorted_ordinal(right, right_order[0], right_order[1:]).select("ordinal", F.col(key).alias("right_key"))
    return a.join(b, "ordinal", "full").withColumn("agrees", F.coalesce(F.col("left_key") == F.col("right_key"), F.lit(False)))


def sorted_ordinal(df: DataFrame, order: Column, ties: Sequence[Column] = (), bins: int | None = None) -> DataFrame:
    """``df`` with a gapless ordinal from 0 by (order, ties), nulls first; ``bins`` ranges, by default as many as the rows ask for."""
    tagged = in_ranges(df, [order, *ties], "__bin", ranges=bins)
    inside = F.row_number().over(Window.partitionBy("__bin").orderBy(order, *ties))
    return totals_before(tagged.withColumn("__rank", inside), [], "__bin", {"__start": F.count("*")}).withColumn("ordinal", F.col("__start") + F.col("__rank") - 1).drop("__bin", "__rank", "__start")


def ordinal_match(onsets: DataFrame, prompts: Column, ordinal: Column, missing: int = -1) -> DataFrame:
    """The prompt element of a row's ordinal (from 0); ``missing`` beyond the list's end."""
    return onsets.withColumn("prompt", F.coalesce(F.get(prompts, ordinal.cast("int")), F.lit(missing)))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: Sequence[str], width: float, first_if_none: bool = True) -> DataFrame:
    """For each left row the last right row of its key with right.time <= left.time.

    ``time`` is numeric and in both sides. Time falls into buckets of ``width``. Only
    rows of one bucket are sorted together; what is still valid from earlier buckets
    comes from a running last over one row a bucket. A key with a third of all rows is
    thus spread over its buckets. Of equal right times the largest struct of
    ``value`` counts. Without an earlier row the key's first one is taken if
    ``first_if_none``, else null.
    """
    keep = [F.col(v) for v in value]
    bucket = F.floor(F.col(time) / width)
    marks = right.groupBy(*keys, time).agg(F.max(F.struct(*keep)).alias("__found")).withColumn("__bucket", bucket)
    probes = left.withColumn("__bucket", bucket)
    per_bucket = marks.groupBy(*keys, "__bucket").agg(F.max_by("__found", time).alias("__last"))
    every = per_bucket.unionByName(probes.select(*keys, "__bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "__bucket").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "__bucket", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    both = probes.withColumn("__probe", F.lit(1)).unionByName(marks.withColumn("__probe", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "__bucket").orderBy(time, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__found", ignorenulls=True).over(upto)).where("__probe = 1").join(carried, [*keys, "__bucket"], "left")
    found = F.coalesce("__seen", "__carried")
    if first_if_none:
        firsts = marks.groupBy(*keys).agg(F.min_by("__found", time).alias("__first"))
        seen = seen.join(firsts, list(keys), "left")
        found = F.coalesce(found, F.col("__first"))
    return seen.withColumn("__hit", found).select(*left.columns, *[F.col(f"__hit.{v}").alias(v) for v in value])


def strongest_in_window(cues: DataFrame, peaks: DataFrame, keys: Sequence[str], before: float, after: float, width: float | None = None) -> DataFrame:
    """For each cue (keys, cue_id, cue) the time of the strongest peak (keys, peak, strength) in [cue - before, cue + after].

    Both sides meet on (key, time bucket): a cue goes to every bucket its window
    touches, two or three of ``width`` (the window's length by default). The
    first of equally strong peaks wins; without a peak the cue itself, at least 0.
    """
    width = width or (before + after)
    spread = F.explode(F.sequence(F.floor((F.col("cue") - before) / width), F.floor((F.col("cue") + after) / width)))
    asked = cues.withColumn("__bucket", spread)
    met = asked.join(peaks.withColumn("__bucket", F.floor(F.col("peak") / width)), [*keys, "__bucket"], "left")
    inside = F.col("peak").between(F.col("cue") - before, F.col("cue") + after)
    best = F.max(F.when(inside, F.struct(F.col("strength"), (-F.col("peak")).alias("earlier"))))
    return met.groupBy(*keys, "cue_id", "cue").agg(best.alias("__best")).select(*keys, "cue_id", "cue", F.coalesce(-F.col("__best.earlier"), F.greatest("cue", F.lit(0.0))).alias("onset"), F.col("__best").isNotNull().alias("found"))


def grid_time(index: Column, bpm: Column, lead: float = 1.3) -> Column:
    """J9's fallback: time of the index-th beat of a uniform grid."""
    return lead + index * 60.0 / bpm


def unseen_share(train: DataFrame, test: DataFrame, fold: str, label: str) -> DataFrame:
    """For each fold the share of test rows whose label is not in that fold's train rows."""
    known = train.select(fold, label).distinct().withColumn("__known", F.lit(1))
    return test.join(known, [fold, label], "left").groupBy(fold).agg(F.avg(F.when(F.col("__known").isNull(), 1.0).otherwise(0.0)).alias("unseen"))


def smallest_first(dim: DataFrame, error: str, ordinal: str) -> DataFrame:
    """The one row with the smallest error, a missing one counting as infinite, the first of equals."""
    return dim.orderBy(F.coalesce(F.col(error), F.lit(float("inf"))), ordinal).limit(1)


def class_pairs(classes: DataFrame, label: str, ordinal: str) -> DataFrame:
    """Pairs (class_a, class_b) of a class list, a before b."""
    b = classes.select(F.col(label).alias("class_b"), F.col(ordinal).alias("__b"))
    return classes.select(F.col(label).alias("class_a"), F.col(ordinal).alias("__a")).join(b, F.col("__a") < F.col("__b")).select("class_a", "class_b")


def two_adapters(endpoints: DataFrame, index: str, explicit: tuple[int, int] | None = None, host: Sequence[str] = ()) -> DataFrame:
    """(first, second): the explicit pair, else the first two endpoints by index; null where one is missing. A row for each host, or a single one.

    Every task keeps two endpoints a host before anything is shuffled.
    """
    chosen = endpoints.where(F.col(index).isin(*explicit)) if explicit else endpoints
    if host:
        ranked = chosen.withColumn("__rank", F.row_number().over(Window.partitionBy(*host).orderBy(index))).where("__rank <= 2")
    else:
        ranked = chosen.select(F.col(index)).orderBy(index).limit(2)
    return ranked.groupBy(*host).agg(F.min(index).alias("first"), F.when(F.count("*") > 1, F.max(index)).alias("second"))


def medians_nearby(asked: DataFrame, rows: DataFrame, keys: Sequence[str], key: str, time: str, value: str, tolerance: float, most: int = 3) -> DataFrame:
    """For each asked row (``keys``, ``key``, ``time``) component-wise medians over the ``most`` rows of its keys that are nearest in time.

    Rows (``keys``, ``time``, ``value`` array<double>) count within ``tolerance`` on both sides, the earlier one first where two are
    as near, then the smaller array. Returns ``key``, n_used, gap (to the nearest) and ``value``; without
    one 0 and nulls. Missing and NaN components are passed over; arrays may differ in length. Null keys and times meet nothing.

    Both sides meet on (keys, time bucket as wide as the tolerance): an asked row goes to three buckets, a row to one.
    So a recording of any length is spread over its buckets, and a task holds what lies within three of them.
    """
    bucket = F.floor(F.col(time) / tolerance)
    probes = asked.select(*keys, key, F.col(time).alias("__at"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("__bucket"))
    found = probes.join(rows.select(*keys, F.col(time).alias("__t"), F.col(value).cast("array<double>").alias("__value"), bucket.alias("__bucket")), [*keys, "__bucket"])
    near = found.withColumn("__gap", F.abs(F.col("__t") - F.col("__at"))).where(F.col("__gap") <= tolerance)
    order = Window.partitionBy(key).orderBy("__gap", "__t", "__value")
    best = near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
    grouped = best.groupBy(key).agg(F.count("*").alias("n_used"), F.min("__gap").alias("gap"), F.collect_list("__value").alias("__all"))  # ``most`` arrays

    def median(k: Column) -> Column:
        parts = F.array_sort(F.filter(F.transform("__all", lambda a: F.get(a, k)), lambda x: x.isNotNull() & ~F.isnan(x)))
        n = F.size(parts)
        return F.when(n > 0, (F.get(parts, F.floor((n - 1) / 2).cast("int")) + F.get(parts, F.floor(n / 2).cast("int"))) / 2)

    longest = F.array_max(F.transform("__all", lambda a: F.coalesce(F.size(a), F.lit(0))))
    middle = F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), median)).otherwise(F.array().cast("array<double>"))
    out = grouped.select(key, "n_used", "gap", middle.alias(value))
    return asked.select(key).join(out, key, "left").select(key, F.coalesce("n_used", F.lit(0)).alias("n_used"), "gap", value)
