"""Onsets, peaks and machines in time windows against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sequence, spacing
from tessera.streaming.machines import cadence, easing, hysteresis, monotonic, one_euro
from tessera.streaming.run import in_buckets, on_table


def gapped(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t >= kept[-1] + gap:
            kept.append(t)
    return kept


def spaced(peaks, gap, most=None):
    kept = []
    for s, t in sorted({(-s, t) for t, s in peaks}):
        if (most is None or len(kept) < most) and all(abs(t - k) >= gap for k, _ in kept):
            kept.append((t, -s))
    return sorted(kept)


def runs(rng):
    """Dense, sparse, rising, falling and tied runs; run x is null."""
    found = {
        "a": [(round(float(t), 2), float(s)) for t, s in zip(rng.uniform(0, 40, 200), rng.integers(0, 6, 200), strict=True)],
        "b": [(float(i), float(i)) for i in range(60)],
        "c": [(0.4 * i, 100.0 - i) for i in range(80)],
        "d": [(5.0, 1.0)],
        "e": [(float(i), 3.0) for i in range(30)] * 2,
        None: [(1.0, 2.0), (1.5, 2.0), (9.0, 1.0)],
    }
    return found


@pytest.mark.parametrize("gap,width", [(1.0, None), (2.5, 3.0), (100.0, None)])
def test_gapped_onsets(spark, gap, width):
    data = runs(np.random.default_rng(1))
    rows = [(k, t) for k, v in data.items() for t, _ in v] + [("a", None), ("z", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "run string, t double").repartition(3)
    found = spacing.gapped_onsets(df, ["run"], "t", gap, width).collect()
    want = [(k, t) for k, v in data.items() for t in gapped([t for t, _ in v], gap)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert spacing.gapped_onsets(df.limit(0), ["run"], "t", gap).count() == 0


@pytest.mark.parametrize("gap,span", [(1.0, 256), (1.0, 3), (2.5, 2)])
def test_spaced_peaks(spark, gap, span):
    data = runs(np.random.default_rng(2))
    rows = [(k, t, s) for k, v in data.items() for t, s in v] + [("a", None, 1.0), ("a", 3.0, None), ("a", float("nan"), 1.0), ("a", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "run string, t double, s double").repartition(3)
    found = spacing.spaced_peaks(df, ["run"], "t", "s", gap, span=span).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(k, *p) for k, v in data.items() for p in spaced(v, gap)], key=str)
    few = spacing.spaced_peaks(df, ["run"], "t", "s", gap, F.when(F.col("run") != "b", 4), span=span).collect()
    want = [(k, *p) for k, v in data.items() for p in spaced(v, gap, None if k in ("b", None) else 4)]
    assert sorted(map(tuple, few), key=str) == sorted(want, key=str)
    assert spacing.spaced_peaks(df.limit(0), ["run"], "t", "s", gap).count() == 0


def test_the_folds_of_short_runs_agree(spark):
    data = {k: v for k, v in runs(np.random.default_rng(3)).items() if k}
    df = spark.createDataFrame([(k, [t for t, _ in v], v) for k, v in data.items()], "run string, ts array<double>, peaks array<struct<t: double, strength: double>>")
    for r in df.select("run", sequence.min_gap(F.col("ts"), 1.0).alias("g"), sequence.top_spaced(F.col("peaks"), 1.0).alias("p")).collect():
        assert r.g == gapped([t for t, _ in data[r.run]], 1.0)
        assert r.p == [t for t, _ in spaced(data[r.run], 1.0)]


def events(spark, rng):
    rows = []
    for user in ("a", "b", None):
        t = 0.0
        for i in range(120):
            t += float(rng.choice([0.0, 0.05, 0.3, 2.0]))
            v = None if rng.random() < 0.1 else float(rng.uniform(0, 100))
            rows.append((user, t, i, v, v, None if v is None else int(rng.integers(0, 50)), [v or 0.0, 0.0, (v or 0.0) + 10, 10.0], f"p{i}"))
    rows.append(("c", None, 0, 70.0, 70.0, 3, None, "x"))
    return spark.createDataFrame(rows, "user string, t double, i int, level double, value double, ts_ms bigint, box array<double>, payload string").repartition(3)


@pytest.mark.parametrize("machine", [hysteresis(60.0), easing(0.15), monotonic(), cadence(), one_euro(beta=0.01)], ids=["hysteresis", "easing", "monotonic", "cadence", "one_euro"])
def test_machines_in_buckets_are_the_machines(spark, machine):
    df = events(spark, np.random.default_rng(4))
    for width in (1.0, 1000.0):
        one, other = on_table(df, machine, "user", ["t", "i"]), in_buckets(df, machine, "user", ["t", "i"], width)
        assert one.columns == other.columns
        normal = lambda rows: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)
        assert normal(one.where("t is not null").collect()) == normal(other.where("t is not null").collect())
    assert in_buckets(df.limit(0), machine, "user", ["t", "i"], 1.0).count() == 0


@pytest.mark.parametrize("machine", [easing(0.3), monotonic()], ids=["easing", "monotonic"])
def test_maps_compose_to_steps(machine):
    rng = np.random.default_rng(5)
    rows = [(None,) if rng.random() < 0.2 else (float(rng.integers(0, 30)),) for _ in range(60)]
    for start in (machine.start, (7.0,)):
        for cut in (1, 20, 59):
            state = start
            for row in rows:
                state, _ = machine.step(state, row)
            parts = []
            for part in (rows[:cut], rows[cut:]):
                made = machine.lift(part[0])
                for row in part[1:]:
                    made = machine.compose(made, machine.lift(row))
                parts.append(made)
            found = machine.act(machine.compose(*parts), start)
            assert found == machine.act(parts[1], machine.act(parts[0], start)) or np.isclose(found[0], machine.act(parts[1], machine.act(parts[0], start))[0])
            assert np.isclose(found[0], state[0])
