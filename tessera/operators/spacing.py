"""Onsets and peaks kept at a distance, for runs of any length: rounds over time windows instead of a fold a run."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import asof_backward
from tessera.plans import materialise

_OPEN, _KEPT, _GONE = 0, 1, 2


def gapped_onsets(onsets: DataFrame, run: Sequence[str], time: str, gap: float, width: float | None = None) -> DataFrame:
    """(``run``, ``time``) of the onsets not before the last one kept plus ``gap`` (above 0); a run's first is kept.

    Every onset's successor is the first one from ``gap`` later on (an as-of join that looks forward, in time buckets of
    ``width``, 64 gaps by default). Kept is what successors lead to from the first: pointers are squared while the kept
    onsets follow them, so a run of n kept onsets takes log2(n) rounds of joins on (run, time), spread over all tasks
    however much of the data is one run's. Null times are left out, equal times count once; null runs are a run.
    """
    names = [f"__r{i}" for i in range(len(run))]
    keys = [F.coalesce(F.to_json(F.struct(F.col(r).alias("k"))), F.lit("")).alias(n) for r, n in zip(run, names, strict=True)]  # null-safe keys
    rows = materialise(onsets.where(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double"))).select(*run, *keys, F.col(time).cast("double").alias("t")).distinct(), "onsets")
    turned = rows.select(*names, (-F.col("t")).alias("x"), F.col("t").alias("after"))
    asked = rows.select(*names, "t", (-(F.col("t") + gap)).alias("x"))
    next_ = asof_backward(asked, turned, names, "x", ["after"], width or 64 * gap, first_if_none=False)
    jumps = materialise(next_.where("after is not null").select(*names, "t", "after"), "jumps")
    kept = materialise(rows.groupBy(*names).agg(F.min("t").alias("t")), "kept")
    while True:
        reached = kept.join(jumps, [*names, "t"]).select(*names, F.col("after").alias("t"))
        kept = materialise(kept.unionByName(reached).distinct(), "kept")
        further = jumps.select(*names, F.col("t").alias("after"), F.col("after").alias("far"))
        jumps = materialise(jumps.join(further, [*names, "after"]).select(*names, "t", F.col("far").alias("after")), "jumps")
        if jumps.isEmpty():
            return rows.join(kept, [*names, "t"], "left_semi").select(*run, F.col("t").alias(time))


def _decided(rows: pd.DataFrame, gap: float) -> np.ndarray:
    """States of a window's rows after all that depends on rows of this window alone; rows of other windows stay as they are.

    Strongest first: a row is gone near a kept one, open near an open one that is stronger, else kept.
    """
    order = np.lexsort((rows.t.to_numpy(), -rows.strength.to_numpy()))
    t, state, own = rows.t.to_numpy(), rows.state.to_numpy().copy(), rows.own.to_numpy()
    kept: list[float] = []
    waiting: list[float] = []

    def near(times: list[float], at: float) -> bool:
        k = bisect_left(times, at)
        return (k < len(times) and abs(times[k] - at) < gap) or (k > 0 and abs(at - times[k - 1]) < gap)

    for i in order.tolist():
        at = float(t[i])
        if state[i] == _OPEN and own[i]:
            state[i] = _GONE if near(kept, at) else _OPEN if near(waiting, at) else _KEPT
        if state[i] == _KEPT:
            insort(kept, at)
        elif state[i] == _OPEN:
            insort(waiting, at)
    return state


def _whole_windows(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole windows of sorted rows, with the windows' starts and the end; one that a batch cuts is carried on."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        batch = pd.concat([*held, batch], ignore_index=True) if held else batch
        new = np.ones(len(batch), bool)
        new[1:] = np.any([batch[k].to_numpy()[1:] != batch[k].to_numpy()[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        held = [batch.iloc[starts[-1] :].reset_index(drop=True)]
        if starts[-1]:
            yield batch.iloc[: starts[-1]], starts
    if held:
        yield held[0], np.array([0, len(held[0])])


def spaced_peaks(peaks: DataFrame, run: Sequence[str], time: str, strength: str, gap: float, most: Column | int | None = None, span: int = 256) -> DataFrame:
    """(``run``, ``time``, ``strength``) of the strongest peaks, each ``gap`` or more from all stronger ones kept; the ``most`` strongest of a run.

    Equally strong peaks: the earlier one first; peaks of equal time and strength count once. ``most`` is a number or a
    column of ``run``; null: all. Null and NaN times and strengths are left out.

    Time falls into windows of ``span`` gaps. In a round each window decides what depends on its own peaks and on what its
    neighbours have decided (``_decided``), and the peaks within a gap of a border are shown to the other side.
    A round settles all but what hangs on an open peak across a border, so a few are enough, and a run with a third of all
    peaks is as many tasks as it has windows. A window holds the peaks of ``span`` gaps. The cut to ``most`` comes last.
    """
    width = gap * span
    names = [f"__r{i}" for i in range(len(run))]
    keys = [F.coalesce(F.to_json(F.struct(F.col(r).alias("k"))), F.lit("")).alias(n) for r, n in zip(run, names, strict=True)]  # null-safe keys
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = peaks.where(number(time) & number(strength)).select(*run, *keys, F.col(time).cast("double").alias("t"), F.col(strength).cast("double").alias("strength"), F.lit(_OPEN).alias("state")).distinct()
    rows = materialise(rows, "peaks")
    known = rows.select(*names, "t", "strength", "state")
    home = F.floor(F.col("t") / width)
    schema = ", ".join([*(f"{n} string" for n in names), "t double, strength double, state int"])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in _whole_windows(batches, [*names, "window"]):
            state = np.concatenate([_decided(batch.iloc[a:b], gap) for a, b in zip(starts[:-1], starts[1:], strict=True)])
            batch = batch.assign(state=state)
            yield batch.loc[batch.own & (batch.state != _GONE), [*names, "t", "strength", "state"]]

    while True:
        seen = known.withColumn("window", F.explode(F.array_distinct(F.array(home, F.floor((F.col("t") - gap) / width), F.floor((F.col("t") + gap) / width)))))
        dealt = seen.withColumn("own", F.col("window") == home).repartition(*names, "window").sortWithinPartitions(*names, "window")
        after = dealt.mapInPandas(step, schema)
        known = materialise(after, "peaks")
        if known.where(F.col("state") == _OPEN).isEmpty():
            break
    found = rows.drop("state").join(known.select(*names, "t", "strength"), [*names, "t", "strength"], "left_semi")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("strength"), "t"))
        limit = F.lit(most) if isinstance(most, int) else most
        found = found.withColumn("__rank", rank).where(limit.isNull() | (F.col("__rank") <= limit))
    return found.select(*run, F.col("t").alias(time), F.col("strength").alias(strength))
