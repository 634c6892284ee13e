"""Short rows that each are much work are dealt to tasks by their number, and kernels give what their plain forms give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import pitchtrack, resample, signal
from tessera.operators import retrieve, vision


@pytest.fixture
def larger(spark, tmp_path):
    spark.range(0, 2000, 1, 1).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(0, 60_000, 1, 1).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")]).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_one_file_becomes_many_tasks(spark, larger):
    assert queries.pure_tones(spark, larger).rdd.getNumPartitions() == 8
    assert queries.sized_parts(spark, larger).rdd.getNumPartitions() == 3
    events, landmarks = queries.hands(spark, larger)
    assert events.rdd.getNumPartitions() == landmarks.rdd.getNumPartitions() == 3
    wires = spark.range(2000).select(F.col("id").alias("frame"), F.lit(1.0).alias("u"))
    assert vision.laws(wires).rdd.getNumPartitions() == 4


def test_tracks_need_no_shuffle(spark):
    events = spark.range(3).select("id", F.lit(8000).alias("rate"), signal.tone(F.lit(200.0) + F.col("id"), [1.0], 8000, 6000).alias("samples")).withColumnRenamed("id", "event_id")
    tracks = pitchtrack.pitch_tracks(events, 2048)
    assert "Exchange" not in tracks._jdf.queryExecution().executedPlan().toString()
    assert tracks.where(F.abs(F.col("hz") - 200 - F.col("event_id").cast("int")) > 0.5).count() == 0 and tracks.count() == 3 * 8


def test_kernels_equal_their_plain_forms():
    rng = np.random.default_rng(5)
    x = rng.random((14, 90))
    for width in (3, 5, 17):
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (width // 2,) * 2
            views = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="reflect"), width, axis=axis)
            assert (signal._median_filter(x, width, axis) == np.median(views, axis=-1)).all()
    y, taps = rng.normal(size=500), resample.low_pass(160, 441)
    stretched = np.zeros(500 * 160)
    stretched[::160] = y
    whole = np.convolve(stretched, taps)[len(taps) // 2 :][: len(stretched)][::441]
    assert np.allclose(resample.resampled(y, 160, 441, 0, 0, len(whole)), whole)


def test_silhouette_sends_a_row_a_bounded_number_of_times(spark):
    """100 rows in blocks of 2 would be 50 copies of each; three blocks are at most four."""
    rng = np.random.default_rng(3)
    v, label = rng.normal(size=(100, 4)).astype(np.float32).astype(float), rng.integers(0, 3, 100)
    df = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, label, strict=True))], "vec_id bigint, embedding array<float>, label int")
    far = np.linalg.norm(v[:, None] - v[None, :], axis=2)
    found = []
    for i in range(100):
        mean = [far[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)]
        a, b = mean[label[i]], min(m for c, m in enumerate(mean) if c != label[i])
        found.append((b - a) / max(a, b))
    for block in (2, 40):
        r = retrieve.silhouette(df, "label", block=block, most=3).first()
        assert r.n == 100 and abs(r.silhouette - np.mean(found)) < 1e-9
