"""Sources, sinks, signal features and streams."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.sources import files, sinks
from tessera.streaming import machines
from tessera.streaming.run import held_share, on_stream, on_table, session_audit


def write_wav(path, samples, rate=48000):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())


def tone(hz=110.0, seconds=0.6, rate=48000):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, 6)) * np.exp(-3 * t) * 0.3


def test_manifests(spark, tmp_path):
    d = tmp_path / "s1" / "p1"
    d.mkdir(parents=True)
    lines = [json.dumps({"run_id": "r1", "frets": [0, 1], "audio": {"clipped": True}, "unknown": 1}), "", "not json", "[1, 2]", json.dumps({"run_id": "r2", "session_id": "other"})]
    (d / "m.jsonl").write_text("\n".join(lines))
    runs = {r.run_id: r for r in files.read_manifests(spark, str(tmp_path)).collect()}
    assert set(runs) == {"r1", "r2"} and runs["r1"].session_id == "s1" and runs["r1"].player_id == "p1" and runs["r2"].session_id == "other" and runs["r1"].audio.clipped and runs["r1"].frets == [0, 1]
    assert sorted(r.line for r in files.rejected_lines(spark, str(tmp_path)).collect()) == ["[1, 2]", "not json"]
    assert files.read_manifests(spark, str(tmp_path), sessions=["s1"], players=["p1"]).count() == 2


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": 1, "points": [1, 2, 3, 4]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    assert [r.x for r in files.read_document(spark, str(tmp_path / "*.json"), "x int, points array<int>").collect()] == [1]
    df = spark.createDataFrame([(1, float("nan"), [1, 2])], "k int, x double, v array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = files.read_table(spark, str(tmp_path / "csv"), "k int, x double, v string").first()
    assert back.k == 1 and np.isnan(back.x) and back.v == "[1,2]"
    assert json.loads(sinks.as_documents(df).first().document) == {"k": 1, "x": None, "v": [1, 2]}
    sinks.append_lines(df.select("k"), str(tmp_path / "log"))
    sinks.append_lines(df.select("k"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert "&lt;" in sinks.html_report("t", {"x": spark.createDataFrame([("<b>", None)], "a string, b int")})
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.upsert_vectors(spark, v, str(tmp_path / "vec"), "id", 0)
    out = sinks.upsert_vectors(spark, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), str(tmp_path / "vec"), "id", 1)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    wide = sinks.channel_frame(spark.createDataFrame([(0, 2, 0.5)], "frame int, ch int, x double"), "frame", "ch", "x", [1, 2, 3]).first()
    assert list(wide) == [0, 0.0, 0.5, 0.0]


def test_wav_windows_and_features(spark, tmp_path):
    write_wav(tmp_path / "a.wav", np.concatenate([tone(), np.zeros(19200)]))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    rows = [("e1", "/x/a.wav", 0.0, 0.6), ("e2", "a.wav", 0.0, 0.001), ("e3", "missing.wav", 0.0, 1.0), ("e4", "bad.wav", 0.0, 1.0)]
    w = files.read_wav_windows(spark, str(tmp_path), spark.createDataFrame(rows, "event_id string, wav_path string, onset_s double, dur_s double"))
    f = {r.event_id: r for r in signal.extract(w).collect()}
    assert set(f) == {"e1", "e2", "e3", "e4"} and f["e1"].spec_centroid > 0 and f["e1"].rms > 0 and abs(f["e1"].pitch_cents_dev) < 20
    assert f["e2"].rms is not None and f["e2"].spec_centroid is None and f["e3"].rms is None and f["e4"].rms is None
    res = signal.extract_residual(w.withColumn("pitches", F.array(F.lit(110.0))))
    assert {r.event_id: r.res_energy_ratio for r in res.collect()}["e1"] < 0.15


def test_noise_raises_the_residual_and_lowers_presence():
    clean, rng = tone(), np.random.default_rng(0)
    noisy = clean + 0.3 * rng.normal(size=len(clean))
    a, b = (signal.residual_features(x, 48000, np.array([110.0]))["res_energy_ratio"] for x in (clean, noisy))
    assert a < 0.15 and b > 2 * a
    assert signal.yin(clean, 48000) == pytest.approx(110, rel=0.01)
    assert signal.harmonic_presence(clean, 48000, 110.0) > signal.harmonic_presence(noisy, 48000, 110.0)
    t, s = signal.onset_envelope(np.concatenate([np.zeros(24000), clean]), 48000)
    assert abs(t[s.argmax()] - 0.5) < 0.06


def test_demo_grid(spark):
    runs = files.demo_runs(spark.createDataFrame([("p1", 0), ("p2", 1)], "player_id string, p int"), [6, 5], [0, 1, 2], ["clean", "buzz", "muted"], 3)
    assert runs.count() == 108 and runs.select("run_id").distinct().count() == 108


def test_hold_then_null(spark):
    quad = [0.0, 0.0, 4.0, 0.0, 4.0, 1.0, 0.0, 1.0]
    rows = [("c", i, quad if i in (0, 8) else None, 0.9) for i in range(10)]
    df = spark.createDataFrame(rows, "client string, i int, quad array<double>, confidence double")
    out = sorted(on_table(df, machines.smooth_and_hold(), "client", ["i"]).collect(), key=lambda r: r.i)
    assert [r.state for r in out] == ["fresh"] + ["held"] * 5 + ["miss"] * 2 + ["fresh", "held"]
    assert out[5].confidence == pytest.approx(0.9 * 0.8**5) and out[6].quad is None
    share = held_share(spark.createDataFrame([(r.client, r.state) for r in out], "client string, state string"), "client").first()
    assert share.fresh == pytest.approx(0.2) and share.held == 6


def test_triggers_and_filters(spark):
    rows = [("s", 0.05 * i, x) for i, x in enumerate((0, 10, 10, 1, 10, 10, 1, 10))]
    df = spark.createDataFrame(rows, "s string, t double, level int")
    hits = [r.hit for r in sorted(on_table(df, machines.hysteresis(5.0), "s", ["t"]).collect(), key=lambda r: r.t)]
    assert hits == [False, True, False, False, True, False, False, True]
    fixed = on_table(spark.createDataFrame([("a", i, x) for i, x in enumerate((5, 5, 3, 9))], "k string, i int, ts_ms bigint"), machines.monotonic(), "k", ["i"])
    assert [r.ts_fixed for r in sorted(fixed.collect(), key=lambda r: r.i)] == [5, 6, 7, 9]
    eased = on_table(spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 2.0)], "k string, i int, value double"), machines.easing(0.15), "k", ["i"])
    assert [r.eased for r in sorted(eased.collect(), key=lambda r: r.i)] == pytest.approx([1, 1, 1.15])
    boxes = spark.createDataFrame([("a", i, [0.0, 0.0, 10.0, 10.0] if i != 3 else [50.0, 0.0, 60.0, 10.0], str(i)) for i in range(10)], "k string, i int, box array<double>, payload string")
    fresh = [r.fresh for r in sorted(on_table(boxes, machines.cadence(), "k", ["i"]).collect(), key=lambda r: r.i)]
    assert fresh == [True, False, False, True, True, False, False, False, False, True]


def test_stream_equals_its_batch_twin(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"u{i % 3}", float(i), float(rng.uniform(0, 10))) for i in range(60)]
    schema = "u string, t double, level double"
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    machine = machines.hysteresis(6.0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = on_stream(stream, machine, "u", ["t"]).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = on_table(spark.createDataFrame(rows, schema), machine, "u", ["t"])
    assert sorted(map(tuple, spark.sql("select * from hits").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_audit_on_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "s", f"r{i % 2}", float(i)) for i in range(9)]
    spark.createDataFrame(rows, "ts string, s string, run string, v double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, s string, run string, v double").json(str(tmp_path / "in"))
    q = session_audit(stream, "ts", "s", "run", F.col("v") > 5, F.col("v") < 1).writeStream.format("memory").queryName("audit").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    out = {r.window_start.minute: (r.events, r.runs, r.clipped, r.silent) for r in spark.sql("select * from audit").collect()}
    assert out == {0: (5, 2, 0, 1), 5: (4, 2, 3, 0)}
