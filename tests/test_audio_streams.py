"""Resampling, containers, decoded pitch, medians nearby and the log of frames."""

import json
import os
from math import gcd

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pitchtrack, resample
from tessera.operators import joins
from tessera.sources import landing


def cents(a, b):
    return 1200 * np.abs(np.log2(np.asarray(a) / np.asarray(b)))


# --- S6, D4


@pytest.mark.parametrize("old,new", [(44100, 16000), (44100, 48000), (48000, 22050), (16000, 16000)])
def test_resampled_tones(old, new):
    g = gcd(old, new)
    up, down, t = new // g, old // g, np.arange(old // 4) / old
    n = -(-len(t) * up // down)
    inner = slice(n // 8, -n // 8)
    low = resample.resampled(np.sin(2 * np.pi * 1000 * t), up, down, 0, 0, n)
    assert np.abs(low - np.sin(2 * np.pi * 1000 * np.arange(n) / new))[inner].max() < 1e-4
    high = resample.resampled(np.sin(2 * np.pi * 11500 * t), up, down, 0, 0, n)[inner]
    assert np.abs(high).max() < 1e-3 if new < 22500 and new < old else np.abs(high).max() > 0.9


@pytest.mark.parametrize("rate", [44100, 48000])
def test_chunks_leave_no_step(spark, rate):
    rng, size = np.random.default_rng(4), 512
    runs = {"a": rng.normal(size=3000).astype(np.float32), "b": rng.normal(size=512).astype(np.float32), "c": rng.normal(size=5).astype(np.float32)}
    df = spark.createDataFrame([(k, rate, v.tolist()) for k, v in runs.items()] + [("d", rate, []), ("e", rate, None), ("f", None, [1.0])], "run string, rate int, samples array<float>")
    chunks = resample.cut_in_chunks(df, "run", size).repartition(4)
    out = resample.resample_chunks(chunks, "run", 16_000, size)
    assert dict(out.groupBy("run").count().collect()) == {"a": 6, "b": 1, "c": 1}
    g = gcd(rate, 16_000)
    up, down = 16_000 // g, rate // g
    for k, x in runs.items():
        rows = out.where(F.col("run") == k).orderBy("chunk").collect()
        found = np.concatenate([r.samples for r in rows])
        n = -(-len(x) * up // down)
        assert len(found) == n and [r.first for r in rows] == np.cumsum([0, *[len(r.samples) for r in rows]])[:-1].tolist()
        assert np.allclose(found, resample.resampled(x.astype(float), up, down, 0, 0, n), atol=1e-5)
    assert resample.resample_chunks(chunks.limit(0), "run", 16_000, size).count() == 0
    with pytest.raises(ValueError, match="reach"):
        resample.resample_chunks(resample.cut_in_chunks(df, "run", 16), "run", 16_000, 16)


def test_runs_are_cut_where_they_are_read(spark, tmp_path):
    """The same chunks as by joins, without a shuffle and in small batches; the filter may reach beyond a chunk."""
    from tessera import queries

    rng = np.random.default_rng(6)
    runs = [("a", 44100, rng.normal(size=3000).tolist()), ("b", 48000, rng.normal(size=512).tolist()), ("c", 16000, [1.0]), ("d", 44100, []), ("e", 44100, None), ("f", None, [1.0]), ("g", 0, [1.0]), (None, 44100, [float("nan"), 1.0, None])]
    df = spark.createDataFrame(runs, "run string, rate int, samples array<float>")
    found = resample.resample_runs(df, "run", 16_000, 512)
    other = resample.resample_chunks(resample.cut_in_chunks(df.where("run is not null and rate is not null"), "run", 512), "run", 16_000, 512)
    by = lambda rows: {(r.run, r.chunk): r for r in rows}
    a, b = by(found.collect()), by(other.collect())
    assert set(a) == {*b, (None, 0)} and found.dtypes == other.dtypes
    assert all(a[k].first == b[k].first and a[k].rate == b[k].rate == 16_000 and np.allclose(a[k].samples, b[k].samples, atol=1e-6) for k in b)
    x = rng.normal(size=300)
    short = spark.createDataFrame([("a", 44100, x.tolist())], "run string, rate int, samples array<float>")
    cut = resample.resample_runs(short, "run", 16_000, 16)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    rows = cut.orderBy("chunk").collect()
    whole = resample.resampled(x, 160, 441, 0, 0, -(-300 * 160 // 441))
    assert len(rows) == 19 and np.allclose(np.concatenate([r.samples for r in rows]), whole, atol=1e-5)
    spark.range(500).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    plan = queries.resampled_tones(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") <= 2
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    assert int(size) <= 2 << 20


def test_containers(spark):
    import io
    import wave

    made = io.BytesIO()
    with wave.open(made, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(b"\0" * 100)
    files = [("pcm", made.getvalue()), ("opus", bytes.fromhex("1A45DFA3") + b"....webm...A_OPUS"), ("alac", b"\0\0\0\x20ftypM4A ....alac"), ("mp3", b"\xff\xfb\x90\x00"), ("aiff", b"FORM....AIFF"), ("empty", b""), ("none", None), ("text", b"hello there")]
    keeps, others = resample.part_by_loss(spark.createDataFrame(files, "name string, content binary"))
    assert {r.name: (r.audio.container, r.audio.codec) for r in keeps.collect()} == {"pcm": ("wav", "pcm"), "alac": ("mp4", "alac"), "aiff": ("aiff", "pcm")}
    assert {r.name: (r.audio.container, r.audio.codec) for r in others.collect()} == {"opus": ("webm", "opus"), "mp3": ("mp3", "mp3"), "empty": (None, None), "none": (None, None), "text": (None, None)}


# --- X9


RATE = 22050


def followed(x, size=2048):
    starts = pitchtrack.frame_starts(len(x), size)
    frames = np.stack([x[s : s + size] for s in starts])
    return starts + size // 4, pitchtrack.decoded(pitchtrack.candidates(frames, RATE), size / 4 / RATE)


def test_glide_is_followed():
    t = np.arange(2 * RATE) / RATE
    f = 220 * 2 ** (t / 2)
    phase = 2 * np.pi * np.cumsum(f) / RATE
    at, hz = followed(np.sin(phase) + 0.5 * np.sin(2 * phase))
    assert not np.isnan(hz).any() and cents(hz, f[at]).max() < 20


@pytest.mark.parametrize("f", [82.4, 147.0, 330.0, 1200.0])
def test_octave_trap(f):
    t = np.arange(RATE) / RATE
    _, hz = followed(0.15 * np.sin(2 * np.pi * f * t) + np.sin(4 * np.pi * f * t) + 0.3 * np.sin(6 * np.pi * f * t))
    assert not np.isnan(hz).any() and cents(hz, f).max() < 20


def test_one_bad_frame_does_not_jump():
    f = [(np.array([200.0, 400.0]), np.array([0.7, 0.2]))] * 5
    f[2] = (np.array([200.0, 400.0]), np.array([0.3, 0.6]))
    assert pitchtrack.decoded(f, 0.02).tolist() == [200.0] * 5
    f = [(np.array([200.0]), np.array([0.9]))] * 3 + [(np.zeros(0), np.zeros(0))] * 6 + [(np.array([300.0]), np.array([0.9]))] * 3
    assert np.nan_to_num(pitchtrack.decoded(f, 0.02)).tolist() == [200.0] * 3 + [0.0] * 6 + [300.0] * 3


def test_unvoiced_gap_and_noise():
    rng, t = np.random.default_rng(0), np.arange(2 * RATE) / RATE
    x = np.sin(2 * np.pi * 196 * t)
    x[int(0.7 * RATE) : int(1.3 * RATE)] = 1e-3 * rng.normal(size=int(1.3 * RATE) - int(0.7 * RATE))
    at, hz = followed(x)
    s = at / RATE
    assert np.isnan(hz[(s > 0.8) & (s < 1.2)]).all() and cents(hz[(s < 0.6) | (s > 1.4)], 196).max() < 20
    assert np.isnan(followed(rng.normal(size=RATE))[1]).mean() > 0.9


def test_event_pitch(spark):
    t = np.arange(RATE) / RATE
    tone = np.sin(2 * np.pi * 261.63 * t)
    broken = [None if i % 997 == 0 else float(v) for i, v in enumerate(tone)]
    rows = [("tone", RATE, tone.tolist()), ("gaps", RATE, broken), ("short", RATE, tone[:900].tolist()), ("frame", RATE, tone[:3000].tolist()), ("silence", RATE, [0.0] * 9000), ("empty", RATE, []), ("none", RATE, None), ("rate", None, [1.0])]
    found = {r.event_id: r for r in pitchtrack.event_pitch(spark.createDataFrame(rows, "event_id string, rate int, samples array<float>"), size=2048).collect()}
    assert set(found) == {r[0] for r in rows}
    for name in ("tone", "gaps", "frame"):
        assert cents(found[name].f0_hz, 261.63) < 20 and found[name].voiced > 0
    assert all(found[n].f0_hz is None and found[n].voiced == 0 for n in ("short", "silence", "empty", "none", "rate"))
    assert pitchtrack.event_pitch(spark.createDataFrame([], "event_id string, rate int, samples array<float>")).count() == 0


# --- S7


def test_medians_nearby(spark):
    rows = [("u", 1.0, [1.0, 10.0]), ("u", 2.0, [2.0, None]), ("u", 4.0, [9.0, 30.0]), ("u", 4.0, [8.0, float("nan")]), ("u", 30.0, [5.0]), ("v", 3.0, [7.0, 7.0]), (None, 3.0, [1.0]), ("u", None, [1.0]), ("u", 3.5, None)]
    asked = [(1, "u", 3.0), (2, "u", 28.0), (3, "u", 100.0), (4, "v", 5.0), (5, None, 3.0), (6, "u", None), (7, "u", 3.0)]
    df = joins.medians_nearby(spark.createDataFrame(asked, "id int, run string, t double"), spark.createDataFrame(rows, "run string, t double, x array<double>"), ["run"], "id", "t", "x", 2.0)
    found = {r.id: (r.n_used, r.gap, r.x) for r in df.collect()}
    assert found[1] == found[7] == (3, 0.5, [5.0, None])  # 3.5 (no array), 2.0, then of the two at 4.0 the smaller
    assert found[2] == (1, 2.0, [5.0]) and found[4] == (1, 2.0, [7.0, 7.0])
    assert all(found[i] == (0, None, None) for i in (3, 5, 6))


def test_medians_nearby_against_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(3)), round(float(rng.uniform(0, 50)), 1), rng.integers(0, 9, 3).astype(float).tolist()) for _ in range(300)]
    asked = [(i, int(rng.integers(3)), round(float(rng.uniform(0, 50)), 1)) for i in range(100)]
    df = joins.medians_nearby(spark.createDataFrame(asked, "id int, run int, t double"), spark.createDataFrame(rows, "run int, t double, x array<double>"), ["run"], "id", "t", "x", 0.7, most=4)
    for r in df.collect():
        _, run, t = asked[r.id]
        near = sorted((abs(b - t), b, x) for own, b, x in rows if own == run and abs(b - t) <= 0.7)[:4]
        assert r.n_used == len(near) and (not near or np.allclose(r.x, np.median([x for _, _, x in near], axis=0)))


# --- S10, S11, T10


def drained(spark, folder, out, checkpoint, most, kinds=()):
    stream = landing.stream_records(spark, folder, os.path.join(checkpoint, "admitted.json"), most, kinds)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sum(p["numInputRows"] for p in query.recentProgress), max([p["numInputRows"] for p in query.recentProgress], default=0)


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("logs", "out", "checkpoint"))
    for i in range(5):
        landing.append(folder, "one", [("frame", 10 * i, b"jpeg%d" % i)])
    landing.append(folder, "two", [("text", 0, b"hello"), ("frame", 1, b""), ("manifest", 2, json.dumps({"run_id": "r"}).encode())])
    total, largest = drained(spark, folder, out, checkpoint, most=2)
    assert total == 8 and largest <= 4
    landing.append(folder, "one", [("frame", 99, b"late")])
    landing.append(folder, "three", [("manifest", 5, b"no json")])
    with open(os.path.join(folder, "two.log"), "ab") as log:
        log.write(b"\0\0\0\xff\0")  # a record that is still being written
    assert drained(spark, folder, out, checkpoint, most=2)[0] == 2
    assert drained(spark, folder, out, checkpoint, most=2)[0] == 0
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("session", "at").distinct().count() == 10
    assert [bytes(r.payload) for r in rows.where("session = 'one'").orderBy("at").collect()] == [b"jpeg0", b"jpeg1", b"jpeg2", b"jpeg3", b"jpeg4", b"late"]
    parsed = landing.manifest_lines(rows, "run_id string").orderBy("session").collect()
    assert [(r.session, r.row.run_id if r.row else None) for r in parsed] == [("three", None), ("two", "r")]


def test_offers_never_fall_behind(tmp_path):
    folder, progress = str(tmp_path / "logs"), str(tmp_path / "p" / "admitted.json")
    landing.append(folder, "s", [("frame", i, b"x" * i) for i in range(6)])
    options = {"path": folder, "progress": progress, "most": "2"}
    one = landing.FrameLogReader(options)
    first, second = one.latestOffset(), one.latestOffset()
    assert 0 < first["s"] < second["s"]
    again = landing.FrameLogReader(options)
    third = again.latestOffset()
    assert third["s"] > second["s"] and again.latestOffset() == third  # all six are offered
    assert [r[3] for r in again.read(again.partitions(first, second)[0])] == [2, 3] and again.partitions(second, second) == []
    only = landing.FrameLogReader(options | {"kinds": "manifest"})
    assert list(only.read(only.partitions({}, second)[0])) == []
    assert landing.FrameLogReader({"path": str(tmp_path / "no"), "progress": str(tmp_path / "q.json")}).latestOffset() == {}
