"""Sequence operators on the onsets, peaks and samples of a run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import HALO, RANGE, Along


def spans(onsets: DataFrame, run: Sequence[str], onset: str, total: Column, ties: Sequence[str] = (), **cut: int) -> DataFrame:
    """Ordinal k from 0, and duration to the next onset or the run's end, at least 0.

    Rows that are equal in onset and ties stand in any order. ``cut`` (here and below) sets the ranges, see ``plans.Along``.
    """
    along = Along(onsets, run, [onset, *ties], **cut)
    w = Window.partitionBy(*run, RANGE).orderBy(onset, *ties, HALO)
    found = along.neighbours(0, 1).withColumn("k", F.row_number().over(w) - 1).withColumn("duration", F.greatest(F.coalesce(F.lead(onset).over(w), total) - F.col(onset), F.lit(0.0)))
    found = along.carried(found.where(~F.col(HALO)), {"__before": (F.count(F.lit(1)), F.sum)})
    return found.withColumn("k", F.col("k") + F.coalesce("__before", F.lit(0))).drop("__before", RANGE, HALO)


def min_gap(times: Column, gap: float) -> Column:
    """Of an array of times those at least ``gap`` after the last one kept; sorted."""
    kept = F.array().cast("array<double>")
    keep = lambda acc, t: F.when(F.size(acc) == 0, F.array(t)).when(t - F.element_at(acc, -1) >= gap, F.concat(acc, F.array(t))).otherwise(acc)
    return F.aggregate(F.array_sort(F.filter(times, lambda t: t.isNotNull())), kept, keep)


def top_spaced(peaks: Column, gap: float, most: Column | None = None) -> Column:
    """Times of the strongest peaks (array of struct t, strength), each ``gap`` from all stronger ones kept, up to ``most``; sorted.

    Equally strong peaks: the earlier one first. ``most`` null: all.
    """
    strongest = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["strength"]).alias("s"), p["t"].cast("double").alias("t"))))
    room = lambda acc: F.lit(True) if most is None else most.isNull() | (F.size(acc) < most)
    take = lambda acc, p: F.when(room(acc) & ~F.exists(acc, lambda t: F.abs(t - p["t"]) < gap), F.concat(acc, F.array(p["t"]))).otherwise(acc)
    return F.array_sort(F.aggregate(strongest, F.array().cast("array<double>"), take))


def with_head(onsets: Column, head_rms: Column, whole_rms: Column, share: float = 0.2, after: float = 0.06) -> Column:
    """Onset 0 in front if the head is loud enough and the first onset is later than ``after``."""
    late = F.coalesce(F.get(onsets, F.lit(0)) > after, F.lit(True))
    return F.when((head_rms > share * whole_rms) & late, F.concat(F.array(F.lit(0.0)), onsets)).otherwise(onsets)


def backtracked(peaks: DataFrame, energy: DataFrame, run: Sequence[str], **cut: int) -> DataFrame:
    """Each peak (run, t) moved to the last local minimum of energy (run, t, energy) before or at it; unmoved without one."""
    w = Window.partitionBy(*run, RANGE).orderBy("t")
    low = (F.col("energy") <= F.coalesce(F.lag("energy").over(w), F.lit(float("inf")))) & (F.col("energy") < F.coalesce(F.lead("energy").over(w), F.lit(float("inf"))))
    near = Along(energy.select(*run, "t", "energy"), run, ["t"], **cut).neighbours(1, 1)
    lows = near.withColumn("__low", low).where(F.col("__low") & ~F.col(HALO))
    both = peaks.select(*run, "t", F.lit(1).alias("__peak")).unionByName(lows.select(*run, "t", F.lit(0).alias("__peak")))
    along = Along(both, run, ["t", "__peak"], **cut)
    at = F.when(F.col("__peak") == 0, F.col("t"))
    upto = Window.partitionBy(*run, RANGE).orderBy("t", "__peak").rowsBetween(Window.unboundedPreceding, 0)
    seen = along.carried(along.rows.withColumn("__seen", F.max(at).over(upto)), {"__last": (F.max(at), F.max)})
    return seen.where("__peak = 1").select(*run, "t", F.coalesce("__seen", "__last", "t").alias("onset"))


def local_maxima(series: DataFrame, run: Sequence[str], order: str, value: str, least_share: float = 0.1, **cut: int) -> DataFrame:
    """Rows above their left and not below their right neighbour, above ``least_share`` of the run's maximum."""
    near, low = Along(series, run, [order], **cut).neighbours(1, 1), F.lit(float("-inf"))
    w = Window.partitionBy(*run, RANGE).orderBy(order)
    peak = (F.col(value) > F.coalesce(F.lag(value).over(w), low)) & (F.col(value) >= F.coalesce(F.lead(value).over(w), low))
    peaks = near.withColumn("__peak", peak).where(F.col("__peak") & ~F.col(HALO)).drop("__peak", RANGE, HALO)
    tops = near.groupBy(*[F.col(k).alias(f"__of_{k}") for k in run]).agg((least_share * F.max(value)).alias("__least"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in run])
    return peaks.join(tops, same).where(F.col(value) > F.col("__least")).drop("__least", *[f"__of_{k}" for k in run])


def moving_average(series: DataFrame, run: Sequence[str], order: str, value: str, radius: int = 4, **cut: int) -> DataFrame:
    """Centred mean, cut off at the ends."""
    near = Along(series, run, [order], **cut).neighbours(radius, radius)
    w = Window.partitionBy(*run, RANGE).orderBy(order).rowsBetween(-radius, radius)
    return near.withColumn("smooth", F.avg(value).over(w)).where(~F.col(HALO)).drop(RANGE, HALO)


def ticks_to_seconds(tempo: DataFrame, run: Sequence[str], per_beat: int = 960, **cut: int) -> DataFrame:
    """Start in seconds of each tempo segment (run, tick, bpm)."""
    w = Window.partitionBy(*run, RANGE).orderBy("tick")
    lasted = (F.col("tick") - F.lag("tick").over(w)) * 60.0 / (F.lag("bpm").over(w) * per_beat)
    along = Along(tempo, run, ["tick"], **cut)
    timed = along.neighbours(1, 0).withColumn("__lasted", F.coalesce(lasted, F.lit(0.0))).where(~F.col(HALO))
    timed = timed.withColumn("start_s", F.sum("__lasted").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    timed = along.carried(timed, {"__before": (F.sum("__lasted"), F.sum)})
    return timed.withColumn("start_s", F.col("start_s") + F.coalesce("__before", F.lit(0.0))).drop("__before", "__lasted", RANGE, HALO)


def bridged_run(widths: Column, narrow: float, most_missing: int = 3, low: float = 0.5, high: float = 2.0) -> Column:
    """Struct (first, last) of the first run of bins narrower than ``narrow``.

    Up to ``most_missing`` missing bins (null or too wide) are bridged if the width after them
    lies within [low, high] of the run's mean so far; null if no bin is narrow.
    """
    start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("done"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        fits = w.isNotNull() & (w < narrow)
        gap = s["i"] - s["last"] - 1
        again = fits & ((gap == 0) | ((gap <= most_missing) & w.between(low * s["sum"] / s["n"], high * s["sum"] / s["n"])))
        begin = F.struct(s["i"].alias("first"), s["i"].alias("last"), w.alias("sum"), F.lit(1).alias("n"), F.lit(False).alias("done"), (s["i"] + 1).alias("i"))
        extend = F.struct(s["first"].alias("first"), s["i"].alias("last"), (s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n"), F.lit(False).alias("done"), (s["i"] + 1).alias("i"))
        wait = F.struct(s["first"].alias("first"), s["last"].alias("last"), s["sum"].alias("sum"), s["n"].alias("n"), (s["done"] | ((s["n"] > 0) & (fits | (gap >= most_missing)))).alias("done"), (s["i"] + 1).alias("i"))
        return F.when(s["done"], wait).when((s["n"] == 0) & fits, begin).when((s["n"] > 0) & F.coalesce(again, F.lit(False)), extend).otherwise(wait)

    end = F.aggregate(F.transform(widths, lambda w: w.cast("double")), start, step)
    return F.when(end["n"] > 0, F.struct(end["first"].alias("first"), end["last"].alias("last")))


def seeded_shuffle(df: DataFrame, parts: Sequence[str], key: Column, seed: int) -> DataFrame:
    """Ordinal from 1 of each row in its part's seeded order, which is drawn anew for each part. Parts are a pass's few runs; null counts as no text."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts], key.cast("string")))
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*parts).orderBy(drawn, key)))


def rounded_peaks(peaks: Column, digits: int) -> Column:
    """Rounded, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.transform(peaks, lambda p: F.round(p, digits))))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, by a partial aggregate rather than a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__row")).select(*keys, "__row.*")


def percentile_threshold(df: DataFrame, event: Sequence[str], value: str, share: float = 0.25, slack: float = 1e-6) -> DataFrame:
    """Rows at or above their event's own percentile less ``slack``; events are short."""
    least = df.groupBy(*event).agg((F.percentile(value, share) - slack).alias("__least"))
    return df.join(least, list(event)).where(F.col(value) >= F.col("__least")).drop("__least")
