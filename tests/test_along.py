"""Windows across ranges against plain Python: hot groups, groups shorter than a border, ties, nulls, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sequence
from tessera.plans import HALO, RANGE, Along


def made(seed=1):
    """Rows (run, t, energy): one run with most rows, short ones, a null run."""
    rng, rows = random.Random(seed), []
    for run, n in (("hot", 300), ("a", 1), ("b", 2), ("c", 7), (None, 25), ("z", 40)):
        rows += [(run, float(t), float(rng.randrange(6))) for t in rng.sample(range(1000), n)]
    rng.shuffle(rows)
    return rows


def by_run(rows):
    found = {}
    for run, t, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])):
        found.setdefault(run, []).append((t, v))
    return found


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(made(), "run string, t double, energy double")


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_copies_are_the_rows_next_to_a_range(series, ranges):
    """With 60 ranges many hold fewer rows than a border asks for."""
    found = Along(series, ["run"], ["t"], ranges=ranges).neighbours(5, 3).collect()
    own = [r for r in found if not r[HALO]]
    assert sorted(map(str, ((r.run, r.t, r.energy) for r in own))) == sorted(map(str, made()))
    assert ranges == 1 or len({r[RANGE] for r in own if r.run == "hot"}) > 3
    for run, rows in by_run(made()).items():
        times = [t for t, _ in rows]
        for part in {r[RANGE] for r in own if r.run == run}:
            inside = sorted(r.t for r in own if r.run == run and r[RANGE] == part)
            copies = sorted(r.t for r in found if r.run == run and r[RANGE] == part and r[HALO])
            lo, hi = times.index(inside[0]), times.index(inside[-1])
            assert inside == times[lo : hi + 1] and copies == times[max(lo - 5, 0) : lo] + times[hi + 1 : hi + 4]


@pytest.mark.parametrize("ranges", [1, 60])
def test_operators_along_runs(spark, series, ranges):
    got = {(r.run, r.t): (r.k, r.duration) for r in sequence.spans(series, ["run"], "t", F.lit(1000.0), ranges=ranges).collect()}
    smooth = {(r.run, r.t): r.smooth for r in sequence.moving_average(series, ["run"], "t", "energy", 4, ranges=ranges).collect()}
    peaks = {(r.run, r.t) for r in sequence.local_maxima(series, ["run"], "t", "energy", 0.5, ranges=ranges).collect()}
    moved = {(r.run, r.t): r.onset for r in sequence.backtracked(series.where("energy > 3"), series, ["run"], ranges=ranges).collect()}
    tempo = series.select("run", F.col("t").alias("tick"), (F.col("energy") + 60).alias("bpm"))
    starts = {(r.run, r.tick): r.start_s for r in sequence.ticks_to_seconds(tempo, ["run"], ranges=ranges).collect()}
    assert len(got) == len(smooth) == len(starts) == len(made())
    for run, rows in by_run(made()).items():
        top, second, last = max(v for _, v in rows), 0.0, None
        for i, (t, v) in enumerate(rows):
            assert got[run, t] == (i, (rows[i + 1][0] if i + 1 < len(rows) else 1000.0) - t)
            near = [x for _, x in rows[max(i - 4, 0) : i + 5]]
            assert smooth[run, t] == pytest.approx(sum(near) / len(near))
            left, right = (rows[i - 1][1] if i else None), (rows[i + 1][1] if i + 1 < len(rows) else None)
            assert ((run, t) in peaks) == ((left is None or v > left) and (right is None or v >= right) and v > 0.5 * top)
            last = t if (left is None or v <= left) and (right is None or v < right) else last
            if v > 3:
                assert moved[run, t] == (t if last is None else last)
            second += (t - rows[i - 1][0]) * 60 / ((rows[i - 1][1] + 60) * 960) if i else 0
            assert starts[run, t] == pytest.approx(second)
    assert len(moved) == sum(v > 3 for _, _, v in made())


def test_ties_repeated_rows_nulls_and_no_rows(spark):
    rows = [("a", 1.0, 1)] * 5 + [("a", 2.0, None), ("a", None, 3)]
    df = spark.createDataFrame(rows, "run string, t double, v int")
    found = sequence.spans(df, ["run"], "t", F.lit(3.0), ranges=3).collect()
    assert sorted(r.k for r in found) == list(range(7)) and sorted(r.duration for r in found if r.t is not None) == [0.0] * 4 + [1.0, 1.0]
    assert sequence.spans(df.limit(0), ["run"], "t", F.lit(3.0)).count() == 0
    assert sequence.moving_average(df.limit(0), ["run"], "t", "v").count() == 0
    assert {r.v for r in sequence.local_maxima(spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 1.0)], "run string, t double, v double"), ["run"], "t", "v", ranges=2).collect()} == {2.0}


def test_only_crossing_groups_carry(spark, series):
    """A group inside one range carries nothing."""
    along = Along(series, ["run"], ["t"], ranges=7)
    found = along.carried(along.rows, {"n": (F.count(F.lit(1)), F.sum)}).collect()
    for run in {r.run for r in found}:
        parts = sorted({r[RANGE] for r in found if r.run == run})
        for r in found:
            if r.run == run:
                before = sum(o.run == run and o[RANGE] < r[RANGE] for o in found)
                assert (r.n or 0) == before and (r.n is None) == (r[RANGE] == parts[0])
