"""Score files with repeats, endings, ties and tempo marks; lines among points."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lines
from tessera.oracles import ORACLES
from tessera.queries import QUERIES
from tessera.sources import scores


def note(string, fret, duration=480, chord=False, ties=(), voice=1, grace=False):
    tie = "".join(f'<tie type="{t}"/>' for t in ties)
    length = "<grace/>" if grace else f"<duration>{duration}</duration>"
    return f"<note>{'<chord/>' if chord else ''}<pitch><step>E</step></pitch>{length}{tie}<voice>{voice}</voice><notations><technical><string>{string}</string><fret>{fret}</fret></technical></notations></note>"


def rest(duration=480):
    return f"<note><rest/><duration>{duration}</duration><voice>1</voice></note>"


def bar(inner, left="", right=""):
    one = lambda side, what: f'<barline location="{side}">{what}</barline>' if what else ""
    return f"<measure>{one('left', left)}{inner}{one('right', right)}</measure>"


OPEN, CLOSE = '<repeat direction="forward"/>', '<repeat direction="backward"/>'
HEAD = "<attributes><divisions>480</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>"


def score(*bars):
    return f'<?xml version="1.0"?><score-partwise version="3.1"><part-list><score-part id="P1"><part-name>x</part-name></score-part></part-list><part id="P1">{"".join(bars)}</part></score-partwise>'


def read(spark, tmp_path, *bars):
    (tmp_path / "song.musicxml").write_text(score(*bars))
    return scores.read_parts(spark, str(tmp_path))


def played(parts):
    return [r.bar for r in scores.unfolded(scores.bars_of(parts)).orderBy("play").collect()]


def test_known_bars_give_known_notes(spark, tmp_path):
    first = note(1, 0) + note(2, 1, chord=True) + rest() + note(3, 2, 960, ties=("start",)) + note(6, 3, grace=True)
    parts = read(
        spark,
        tmp_path,
        bar(HEAD + '<direction><sound tempo="60"/></direction>' + first),
        bar(note(3, 2, 480, ties=("stop",)) + note(4, 5, 1440), left=OPEN),
        bar(note(5, 6, 1920), left='<ending number="1" type="start"/>', right='<ending number="1" type="stop"/>' + CLOSE),
        bar('<sound tempo="120"/>' + note(6, 7, 1920), left='<ending number="2" type="start"/>', right='<ending number="2" type="discontinue"/>'),
        bar(note(1, 8, 240) + note(1, 9, 24)),
    )
    assert played(parts) == [0, 1, 2, 1, 3, 4]
    found = [tuple(r)[2:] for r in scores.chart_of(parts).orderBy("t", "string").collect()]
    assert found == [(0.0, 1, 0, 1.0, 1), (0.0, 2, 1, 1.0, 1), (2.0, 3, 2, 2.0, None), (5.0, 4, 5, 3.0, None), (8.0, 5, 6, 4.0, None), (13.0, 4, 5, 3.0, None), (16.0, 6, 7, 2.0, None), (18.0, 1, 8, 0.25, None), (18.25, 1, 9, 0.05, None)]
    turned = scores.chart_of(parts, seven_strings=True).where("t = 18").first()
    assert turned.string == 6


def test_a_length_within_a_bar_is_one_quotient(spark, tmp_path):
    """A quarter at 128 is 0.46875 s and rounds up, wherever sums of bars at other tempos put it."""
    quarters = "".join(note(1, k) for k in range(4))
    parts = read(spark, tmp_path, *[bar((HEAD if k == 0 else "") + f'<sound tempo="{t}"/>' + quarters) for k, t in enumerate((61, 68, 128, 128))])
    found = scores.chart_of(parts).groupBy("dur").count().collect()
    assert {r.dur: r["count"] for r in found} == {0.4688: 8, round(60 / 61, 4): 4, round(60 / 68, 4): 4}


def test_charts_round_and_begin_as_their_sql_does(spark, tmp_path):
    """Three bars at 100 and a quarter at 128 end at 7.66875 s, which sums leave just below; a conversation may begin with a null text."""
    turns = [(1, 0, "a" * 40), (1, 1, "a"), (1, 2, "b"), (1, 3, "a" * 68), (2, 0, None), (2, 1, "abc"), (2, 2, "abcd"), (2, 3, "a" * 7)]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ["conv_id", "t", "string", "fret", "dur", "chord"]
    want = [tuple(str(v) for v in r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['score_charts']})").fetchall()]
    got = [tuple(str(v) for v in r) for r in QUERIES["score_charts"](spark, str(tmp_path)).select(columns).collect()]
    assert sorted(got) == sorted(want) and ("1", "7.6688") in {r[:2] for r in got}


def against_sql(spark, path, turns):
    """The rows of score_charts and of its SQL over (conv_id, turn, text), sorted."""
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    columns = ["conv_id", "t", "string", "fret", "dur", "chord"]
    want = sorted(tuple(str(v) for v in r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['score_charts']})").fetchall())
    return sorted(tuple(str(v) for v in r) for r in QUERIES["score_charts"](spark, str(path)).select(columns).collect()), want


@pytest.mark.parametrize("slow,fast,marked", [(100, 128, 24), (75, 128, 33), (90, 128, 27)])
def test_a_long_run_of_bars_adds_up_as_in_sql(spark, tmp_path, slow, fast, marked):
    """Times that end in a five at the fifth digit, after more bars than one sum after the other adds up well enough."""
    got, want = against_sql(spark, tmp_path, [(1, k, "a" * ((fast if k >= marked else slow) - 60)) for k in range(marked + 4)])
    assert got == want


def test_sums_by_blocks_are_the_sums(spark):
    found = scores.sum_before(spark.range(5000).select(F.lit("s").alias("score"), (F.col("id") % 2).cast("string").alias("part"), F.floor(F.col("id") / 2).alias("play")), F.col("play") * 0.1, "total")
    rows = found.orderBy("part", "play").collect()
    assert [r.play for r in rows] == [*range(2500)] * 2 and found.columns == ["score", "part", "play", "total"]
    assert all(math.isclose(r.total, r.play * (r.play - 1) / 20, rel_tol=1e-14) for r in rows)


def test_turns_and_conversations_without_a_number(spark, tmp_path):
    """A turn without a number comes last; turns of no conversation are a part of their own."""
    got, want = against_sql(spark, tmp_path, [(1, None, "abc"), (1, 0, "abcd"), (1, 3, "ab"), (2, None, "a" * 9), (None, 3, "abcd"), (None, 0, "b"), (None, None, "cc")])
    assert got == want and {r[0] for r in got} == {"1", "2", "None"}


@pytest.mark.parametrize(
    "bars,order",
    [
        ([("", ""), ("", CLOSE), ("", "")], [0, 1, 0, 1, 2]),  # no opening sign: from the start
        ([("", CLOSE), ("", CLOSE)], [0, 0, 1, 1]),
        ([("", ""), (OPEN, '<repeat direction="backward" times="3"/>'), ("", "")], [0, 1, 1, 1, 2]),
        ([(OPEN, ""), ("", CLOSE), (OPEN, CLOSE), ("", "")], [0, 1, 0, 1, 2, 2, 3]),
        ([(OPEN, ""), ('<ending number="1, 2" type="start"/>', '<ending number="1, 2" type="stop"/><repeat direction="backward" times="3"/>'), ('<ending number="3" type="start"/>', '<ending number="3" type="stop"/>'), ("", "")], [0, 1, 0, 1, 0, 2, 3]),
        ([(OPEN, ""), ('<ending number="1" type="start"/>', ""), ("", '<ending number="1" type="stop"/>' + CLOSE), ('<ending number="2" type="start"/>', ""), ("", '<ending number="2" type="stop"/>'), ("", "")], [0, 1, 2, 0, 3, 4, 5]),
        ([("", ""), ("", "")], [0, 1]),
        ([], []),
    ],
)
def test_repeats(spark, tmp_path, bars, order):
    parts = read(spark, tmp_path, *[bar((HEAD if i == 0 else "") + note(1, 0), left, right) for i, (left, right) in enumerate(bars)])
    assert played(parts) == order


def test_voices_chords_and_signatures(spark, tmp_path):
    three = "<attributes><divisions>2</divisions><time><beats>3</beats><beat-type>8</beat-type></time></attributes>"
    parts = read(spark, tmp_path, bar(three + note(1, 0, 1) + note(2, 0, 1, chord=True) + note(1, 1, 2) + "<backup><duration>3</duration></backup>" + note(5, 0, 3, voice=2)), bar(note(3, 3, 3)))
    found = [(r.t, r.string, r.fret, r.dur, r.chord) for r in scores.chart_of(parts).orderBy("t", "string").collect()]
    assert found == [(0.0, 1, 0, 0.25, 1), (0.0, 2, 0, 0.25, 1), (0.0, 5, 0, 0.75, None), (0.25, 1, 1, 0.5, None), (0.75, 3, 3, 0.75, None)]


def grid_twin(points, angles, step):
    votes = Counter()
    for x, y in points:
        for k in range(angles):
            t = k * (math.pi / angles)
            votes[k, math.floor((x * math.cos(t) + y * math.sin(t)) / step + 0.5)] += 1
    return votes


def peaks_twin(votes, angles, da, do, least):
    strong = {c: n for c, n in votes.items() if n >= least}
    kept = set()
    for (a, o), n in strong.items():
        rivals = [(m, -b, -p) for (b, p), m in strong.items() for shift, sign in ((0, 1), (angles, -1), (-angles, -1)) if abs(b + shift - a) <= da and abs(sign * p - o) <= do]
        if max(rivals) == (n, -a, -o):
            kept.add((a, o))
    return kept


def scene(rng, noise=60):
    """Two lines, 0.2 and 0.22 rad from the vertical, 40 apart, among noise."""
    points = [tuple(p) for p in rng.uniform(0, 200, (noise, 2)).tolist()]
    for t, offset in ((0.2, 60.0), (0.22, 100.0)):
        for s in np.linspace(-20, 120, 80):
            points.append((offset * math.cos(t) - s * math.sin(t) + rng.normal(0, 0.2), offset * math.sin(t) + s * math.cos(t) + rng.normal(0, 0.2)))
    return points


def test_votes_and_peaks(spark):
    rng = np.random.default_rng(3)
    frames = {1: scene(rng, 20), 2: [(float(i), 0.0) for i in range(12)], 3: [(5.0, 5.0)]}
    odd = [(1, None, 1.0), (1, float("nan"), 1.0), (1, float("inf"), 1.0), (4, None, None)]
    df = spark.createDataFrame([(f, float(x), float(y)) for f, ps in frames.items() for x, y in ps] + odd, "frame int, x double, y double").repartition(3)
    grid = lines.vote_grid(df, ["frame"], 36, 4.0)
    votes = {f: grid_twin(ps, 36, 4.0) for f, ps in frames.items()}
    assert {(r.frame, r.angle, r.offset): r.votes for r in grid.collect()} == {(f, *c): n for f, v in votes.items() for c, n in v.items()}
    for da, do in ((2, 3), (5, 1)):
        found = {(r.frame, r.angle, r.offset) for r in lines.grid_peaks(grid, ["frame"], 36, da, do, 3).collect()}
        assert found == {(f, *c) for f, v in votes.items() for c in peaks_twin(v, 36, da, do, 3)}
    assert lines.grid_peaks(grid.limit(0), ["frame"], 36).count() == 0


def test_two_planted_edges_in_noise(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f, float(x), float(y)) for f in range(4) for x, y in scene(rng)], "frame int, x double, y double")
    for r in lines.neck_edges(df, ["frame"], 180, 2.0, least=25).collect():
        found = sorted([(r.offset_a * 2.0, r.angle_a), (r.offset_b * 2.0, r.angle_b)])
        assert abs(found[0][0] - 60) <= 4 and abs(found[1][0] - 100) <= 4
        assert all(abs(a * math.pi / 180 - 0.21) < 0.05 for _, a in found)
    assert lines.neck_edges(df, ["frame"], 180, 2.0, least=25).count() == 4
    assert lines.neck_edges(df.where("frame < 0"), ["frame"]).count() == 0


def test_copies_of_cells_are_not_broadcast(spark, tmp_path):
    """A scan of few bytes becomes many cells and nine copies of each; the driver gathers none of them."""
    from tessera import queries

    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    found = queries.neck_edges(spark, str(tmp_path))
    assert found.count() == 40
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f, float(x), float(y)) for f in range(3) for x, y in scene(rng, 5)], "frame int, x double, y double")
    peaks = lines.grid_peaks(lines.vote_grid(df, ["frame"], 36, 2.0), ["frame"], 36)
    for plan in (found, peaks):
        plan.collect()
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in said and "Broadcast" not in said


def test_weights_count_for_votes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.5), (1, 0.0, 0.0, None)], "frame int, x double, y double, g double")
    grid = lines.vote_grid(df, ["frame"], 4, 1.0, F.col("g")).collect()
    assert [(r.angle, r.offset, r.votes) for r in sorted(grid)] == [(k, 0, 2.5) for k in range(4)]
