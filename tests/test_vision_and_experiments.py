"""Board fits, hand features, and the experiments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.contract import VISION_FEATURES
from tessera.operators import experiments as ex
from tessera.operators import vision


def board_points(n=8):
    return np.array([(1 - 2.0 ** (-f / 12), s) for f in range(n) for s in (0, 1)])


def in_image(board):
    h = np.array([[900.0, -60, 150], [-40, 220, 470], [-0.05, 0.02, 1]])
    p = np.c_[board, np.ones(len(board))] @ h.T
    return p[:, :2] / p[:, 2:]


def test_homography_round_trip():
    board, rng = board_points(), np.random.default_rng(0)
    image = in_image(board)
    assert np.median(vision.reprojection(vision.fit_homography(board, image + rng.normal(0, 1.5, image.shape)), board, image)) < 4
    assert vision.reprojection(vision.fit_homography(board, image), board, image).max() < 1e-6


def test_registrations_and_twin(spark):
    rng, rows = np.random.default_rng(1), []
    for frame, noise, frets in (("good", 1.2, 8), ("bad", 60.0, 8), ("few", 1.0, 3)):
        image = in_image(board_points(frets)) + rng.normal(0, noise, (2 * frets, 2))
        rows += [(frame, k // 2, k % 2, float(x), float(y)) for k, (x, y) in enumerate(image)]
    got = {r.frame: r for r in vision.registrations(spark.createDataFrame(rows, "frame string, fret int, side int, x double, y double")).collect()}
    assert (got["good"].stage, got["bad"].stage, got["few"].stage) == ("ok", "fit", "too_few_frets") and got["good"].residual_px < 6 and got["few"].h is None
    frames = spark.createDataFrame([("g", r.frame, r.stage, r.residual_px, r.h) for r in got.values()], "guitar string, frame string, stage string, residual_px double, h array<array<double>>")
    t = vision.twin(frames, "guitar").first()
    assert t.n_keyframes == 1 and t.median_reproj_px == got["good"].residual_px


def test_law():
    places = 900 * (1 - 2.0 ** (-np.array([0, 1, 2, 3, 5, 6, 7, 8, 9, 10]) / 12))
    for sign in (1, -1):
        got = vision.fit_law(40 + sign * places)
        assert got["sign"] == sign and abs(got["nut"] - 40) < 3 and abs(got["scale"] - 900) < 20 and (got["inliers"], got["gaps"]) == (10, 1)
        assert got["residual"] < 3 and 0 < got["quality"] <= 1
    assert vision.fit_law(np.array([1.0, 2.0, 3.0])) is None and vision.fit_law(np.zeros(0)) is None


def test_robust_homography_leaves_wild_points_out():
    board = board_points()
    image = in_image(board)
    image[3] += 90
    image[8] -= 70
    good = np.delete(np.arange(len(board)), [3, 8])
    assert vision.reprojection(vision.robust_homography(board, image), board, image)[good].max() < 1e-6
    assert vision.reprojection(vision.fit_homography(board, image), board, image)[good].max() > 1


def test_hand_features(spark):
    h = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    wire = 1 - 2 ** (-1 / 12)
    tips = {f: (wire - 0.02 if f == "index" else 0.9, 0.0) for f in ("index", "middle", "ring", "pinky")}
    joints = {"wrist": (0.0, 1.0), "middle_mcp": (0.0, 0.0), "index_mcp": (0.0, 0.0), "index_pip": (1.0, 0.0), "index_tip": (2.0, 0.0)}
    point = "map<string,struct<x:double,y:double>>"
    lm = spark.createDataFrame([("e1", tips, joints, 0.9)], f"event_id string, tips {point}, joints {point}, conf double")
    ev = spark.createDataFrame([("e1", 1, "index"), ("e2", 3, "ring")], "event_id string, target_fret int, finger string")
    board = spark.createDataFrame([(h, 0.1)], "h array<array<double>>, reproj_px double")
    got = {r.event_id: r for r in vision.vision_features(ev, lm, board).collect()}
    assert got["e1"].d_active == pytest.approx(-0.02) and got["e1"].fret_est == 1 and got["e1"].string_est == 6 and got["e1"].finger_curl_active == pytest.approx(0) and got["e1"].hand_conf == 0.9
    assert all(got["e2"][f] is None for f in VISION_FEATURES)
    poses = vision.pose_rows(ev, lm)
    assert poses.count() == 4 and len(vision.pose_matrix(poses).first()) == 13


def blobs(spark, n=200):
    rng = np.random.default_rng(3)
    rows = [(i, int(c), i % 10, *map(float, rng.normal(0, 1, 2) + (3 * c, 0)), float(rng.normal())) for i, c in enumerate(rng.integers(0, 2, n))]
    return spark.createDataFrame(rows, "id int, y int, run int, a double, b double, noise double")


def test_experiments(spark):
    df = blobs(spark)
    held = ex.holdout(df, "y", "id")
    assert held.where("held_out").count() == pytest.approx(40, abs=2)
    gap = ex.leakage_gap(df, "y", ["a", "b"], "id", "run").first()
    assert gap.random > 0.85 and gap.grouped > 0.85 and not gap.leaks
    folded = df.withColumn("fold", F.col("id") % 5)
    arms = {r.arm: r.accuracy for r in ex.ablation(folded, "y", {"good": ["a"], "bad": ["noise"]}, "id").collect()}
    assert arms["good"] > 0.85 and arms["bad"] < 0.7 and 0.5 <= arms["majority"] < 0.6
    moved = ex.transfer(df, df, "y", ["a", "b"]).groupBy("y").agg(F.avg("position").alias("p")).orderBy("y").collect()
    assert [r.p for r in moved] == pytest.approx([0, 1])
    assert ex.off_detection(df, "y", ["a", "b"], "id").first().auc > 0.85
    assert ex.medoids(df, "y", ["a", "b"], "id").count() == 2
    even = ex.controlled(df, "a", ["y"]).groupBy("y").agg(F.avg("a_controlled").alias("m")).collect()
    assert even[0].m == pytest.approx(even[1].m)
    assert ex.position_folds(df, ["y"], "run", 4).groupBy("y", "run").agg(F.count_distinct("fold").alias("f")).where("f > 1").count() == 0
    assert ex.promotion(df.where("run < 5"), "a", "run").first().least_groups == 5
    assert ex.loudest_first(df, ["y"], "a", 3).count() == 6


def test_offset_and_quarantine(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=60)
    rows = [("r", t, float(a[t]), float(a[t - 3]) if t >= 3 else 0.0) for t in range(60)]
    assert ex.av_offset(spark.createDataFrame(rows, "run string, t int, a double, v double"), "run", "t", "a", "v", 5).first().lag == 3
    runs = spark.createDataFrame([("x", 2, "y"), ("y", 1, "n"), ("z", 1, None)], "run string, expected_note_count int, matched_intent string")
    events = spark.createDataFrame([("x",), ("x",), ("y",)], "run string")
    assert {r.run: r.quarantined for r in ex.quarantine(runs, events, ["run"]).collect()} == {"x": False, "y": True, "z": True}
