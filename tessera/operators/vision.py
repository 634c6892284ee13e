"""Board geometry of hands: native features of a landmarks table, and small fits per frame."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.contract import FINGERS, VISION_FEATURES
from tessera.functions import geometry, pitch
from tessera.functions.values import to_double


def _curl(joints: Column, finger: str) -> Column:
    """180 degrees less the angle at a finger's middle joint."""
    at = lambda part: joints[f"{finger}_{part}"]
    return 180.0 - geometry.angle_at(at("mcp"), at("pip"), at("tip"))


def vision_features(events: DataFrame, landmarks: DataFrame, board: DataFrame) -> DataFrame:
    """VISION_FEATURES of every event; all null without landmarks or a board.

    events: event_id, target_fret, finger. landmarks (at most one row an event): event_id, tips
    map<finger, point>, joints map<name, point>, conf. board, a single row: h (image to board), reproj_px.
    The active finger is the named one if its distance is known, else the nearest. All of it is
    expressions on the joined row.
    """
    met = events.join(landmarks, "event_id", "left").join(board, F.lit(True), "left")  # one row
    at = {f: geometry.project(F.col("h"), F.col("tips")[f]["x"], F.col("tips")[f]["y"]) for f in FINGERS}
    fret = F.when(F.col("target_fret") > 0, F.col("target_fret"))
    met = met.withColumns({f"__d_{f}": pitch.behind_wire(at[f]["x"], F.coalesce(fret, pitch.nearest_fret(at[f]["x"]))) for f in FINGERS})
    offsets = F.create_map(*[x for f in FINGERS for x in (F.lit(f), F.col(f"__d_{f}"))])
    active = geometry.active_finger(F.coalesce(F.col("finger"), F.lit("")), offsets, FINGERS)
    met = met.withColumn("__active", active)
    pick = lambda columns: F.coalesce(*[F.when(F.col("__active") == f, c) for f, c in columns.items()])
    curls = {f: _curl(F.col("joints"), f) for f in FINGERS}
    known = F.filter(F.array(*curls.values()), lambda c: c.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, c: s + c) / F.size(known))
    found = {
        "d_active": pick({f: F.col(f"__d_{f}") for f in FINGERS}),
        **{f"d_{f}": F.col(f"__d_{f}") for f in FINGERS},
        "string_est": pick({f: pitch.string_at(at[f]["y"]).cast("double") for f in FINGERS}),
        "fret_est": pick({f: pitch.nearest_fret(at[f]["x"]).cast("double") for f in FINGERS}),
        "finger_curl_active": pick(curls),
        "finger_curl_mean": mean,
        "wrist_angle": geometry.direction(F.col("joints")["wrist"], F.col("joints")["middle_mcp"]),
        "neck_angle": F.when(F.col("joints").isNotNull() & F.col("h").isNotNull(), F.degrees(F.atan2(-F.col("h")[1][0], F.col("h")[1][1]))),
        "hand_conf": F.col("conf"),
        "reproj_px": F.when(F.col("conf").isNotNull(), F.col("reproj_px")),
    }
    return met.select("event_id", *[F.coalesce(to_double(found[n].cast("string")), F.lit(None)).alias(n) for n in VISION_FEATURES])


def pose_rows(events: DataFrame, landmarks: DataFrame) -> DataFrame:
    """A row for each event and finger: place relative to the wrist in hand lengths, and the curl."""
    met = events.join(landmarks, "event_id")
    scale = geometry.distance(F.col("joints")["wrist"], F.col("joints")["middle_mcp"])
    scale = F.when(scale < 1e-6, 1.0).otherwise(scale)
    rel = lambda f, k: (F.col("tips")[f][k] - F.col("joints")["wrist"][k]) / scale
    cells = F.array(*[F.struct(F.lit(f).alias("finger"), rel(f, "x").alias("x"), rel(f, "y").alias("y"), _curl(F.col("joints"), f).alias("curl")) for f in FINGERS])
    return met.select("event_id", F.explode(cells).alias("p")).select("event_id", "p.*")


def pose_matrix(poses: DataFrame) -> DataFrame:
    """One row an event with every finger's pose; missing and infinite values are 0."""
    wide = poses.groupBy("event_id").pivot("finger", list(FINGERS)).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("x", "y", "curl")])
    return wide.select("event_id", *[F.coalesce(to_double(F.col(c).cast("string")), F.lit(0.0)).alias(c) for c in wide.columns if c != "event_id"])


def fit_homography(board: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Least-squares 3x3 matrix from board to image points, both scaled to their spread first."""
    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = max(np.abs(p - p.mean(0)).mean(), 1e-9)
        t = np.array([[1 / size, 0, -p[:, 0].mean() / size], [0, 1 / size, -p[:, 1].mean() / size], [0, 0, 1]])
        return (p - p.mean(0)) / size, t

    (b, tb), (i, ti) = scaled(board), scaled(image)
    rows = []
    for (x, y), (u, v) in zip(b, i, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.inv(ti) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ tb
    return h / h[2, 2]


def reprojection(h: np.ndarray, board: np.ndarray, image: np.ndarray) -> np.ndarray:
    """distances of the projected board points to the image points."""
    p = np.c_[board, np.ones(len(board))] @ h.T
    return np.hypot(*(p[:, :2] / p[:, 2:] - image).T)


def registrations(points: DataFrame, most_px: float = 6.0, least_frets: int = 4, robust: bool = False) -> DataFrame:
    """A homography a frame from wire points (frame, fret, side 0 or 1, x, y).

    Wires may be counted from 0, 1 or 2; the count with the least median error wins, the first of equals. stage:
    too_few_frets, fit (the error exceeds ``most_px``) or ok. ``robust``: points far off are left out of the fit.
    """

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        image = rows[["x", "y"]].to_numpy(float)
        frets = rows["fret"].nunique()
        if frets < least_frets or len(rows) < 4:
            return pd.DataFrame([(key[0], "too_few_frets", frets, None, None, None)], columns=names)
        best = None
        for nut in range(3):
            board = np.c_[1 - 2.0 ** (-(rows["fret"].to_numpy(float) + nut) / 12), rows["side"].to_numpy(float)]
            h = robust_homography(board, image, most_px) if robust else fit_homography(board, image)
            error = float(np.median(reprojection(h, board, image)))
            if best is None or error < best[0]:
                best = (error, nut, h)
        return pd.DataFrame([(key[0], "ok" if best[0] <= most_px else "fit", frets, best[1], best[0], best[2].tolist())], columns=names)

    names = ["frame", "stage", "n_frets", "nut", "residual_px", "h"]
    kind = dict(points.dtypes)["frame"]
    return points.groupBy("frame").applyInPandas(solve, f"frame {kind}, stage string, n_frets int, nut int, residual_px double, h array<array<double>>")


#: Fixed values of the law fit: wires counted, least wires, least range and distance of two anchors, least tolerance, share of the range tolerated, residual (in scales) that costs half of the quality.
WIRES, LEAST_WIRES, LEAST_RANGE, LEAST_APART, LEAST_OFF, OFF_SHARE, HALF_OFF = 14, 5, 10.0, 8.0, 5.0, 0.05, 0.020


def fit_law(places: np.ndarray) -> dict[str, float] | None:
    """Nut, scale, sign and fit of wire places under x = nut + sign * scale * (1 - 2^(-n / 12)); None if too few wires fit.

    Any two places can be two wires up to four numbers apart, the lower of them among the first four, with the nut at
    either end. All these laws are scored at once: wires met, less 1.3 for each number skipped between them, less the mean distance in
    tolerances. A wire met by several places keeps the nearest.
    """
    places = np.unique(np.round(np.asarray(places, float), 1))
    reach = float(np.ptp(places)) if len(places) else 0.0
    if len(places) < LEAST_WIRES or reach < LEAST_RANGE:
        return None
    tolerance = max(LEAST_OFF, OFF_SHARE * reach)
    fractions = 1 - 2.0 ** (-np.arange(WIRES + 1) / 12)
    low, high = np.nonzero(np.triu(places[None, :] - places[:, None] >= LEAST_APART, 1))
    lower, step, sign = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(1, 5), [1.0, -1.0], indexing="ij"))
    near = np.where(sign > 0, places[low][:, None], places[high][:, None])  # the anchor that lies nearer to the nut
    scale = ((places[high] - places[low])[:, None] / (fractions[lower + step] - fractions[lower])[None, :]).ravel()
    sign = np.broadcast_to(sign, near.shape).ravel()
    nut = near.ravel() - sign * scale * np.broadcast_to(fractions[lower], near.shape).ravel()
    best = None
    for at in np.array_split(np.arange(len(nut)), max(1, len(nut) // 2000)):
        off = np.abs(places[None, :, None] - (nut[at, None] + (sign * scale)[at, None] * fractions)[:, None, :])
        own = off.argmin(axis=2)[:, :, None] == np.arange(WIRES + 1)  # a place belongs to its nearest wire
        least = np.where(own & (off <= tolerance), off, np.inf).min(axis=1)
        met = np.isfinite(least)
        count = met.sum(axis=1)
        gaps = np.where(count > 0, WIRES + 1 - met[:, ::-1].argmax(axis=1) - met.argmax(axis=1) - count, 0)
        residual = np.where(met, least, 0).sum(axis=1) / np.maximum(count, 1)
        score = np.where(count >= LEAST_WIRES, np.round(count - 1.3 * gaps - residual / tolerance, 4), -np.inf)
        k = int(score.argmax())
        if np.isfinite(score[k]) and (best is None or score[k] > best[0]):
            best = (score[k], at[k], int(count[k]), int(gaps[k]), float(residual[k]))
    if best is None:
        return None
    _, k, count, gaps, residual = best
    quality = float(np.clip(count / 8 - 0.1 * gaps - residual / max(scale[k], 1.0) / HALF_OFF / 2, 0, 1))
    return {"nut": float(nut[k]), "scale": float(scale[k]), "sign": float(sign[k]), "fret7": float(nut[k] + sign[k] * scale[k] * fractions[7]), "inliers": count, "gaps": gaps, "residual": residual, "quality": quality}


def laws(wires: DataFrame) -> DataFrame:
    """The law of every frame's wire places (frame, u); a frame in which too few wires fit has nulls."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = fit_law(rows["u"].dropna().to_numpy(float)) or {}
        return pd.DataFrame([(key[0], *[found.get(n) for n in names])], columns=["frame", *names])

    names = ["nut", "scale", "sign", "fret7", "inliers", "gaps", "residual", "quality"]
    kind = dict(wires.dtypes)["frame"]
    # a frame's few places are little to send and much to fit: tasks by frames, not by bytes
    tasks = max(1, -(-wires.select("frame").distinct().count() // 500))
    return wires.repartition(tasks, "frame").groupBy("frame").applyInPandas(solve, f"frame {kind}, nut double, scale double, sign double, fret7 double, inliers int, gaps int, residual double, quality double")


def robust_homography(board: np.ndarray, image: np.ndarray, most_px: float = 6.0, draws: int = 200, seed: int = 7) -> np.ndarray:
    """The least-squares matrix of the points that agree, within ``most_px``, with the four points most agree with.

    All fours are tried if there are no more than ``draws`` of them, else so many seeded draws.
    """
    fours = list(itertools.islice(itertools.combinations(range(len(board)), 4), draws + 1))
    if len(fours) > draws:
        rng = np.random.default_rng(seed)
        fours = [rng.choice(len(board), 4, replace=False) for _ in range(draws)]
    best = np.zeros(len(board), bool)
    for four in map(list, fours):
        with np.errstate(all="ignore"):
            h = fit_homography(board[four], image[four])
            agree = reprojection(h, board, image) <= most_px if np.isfinite(h).all() else best
        if agree.sum() > best.sum():
            best = agree
    return fit_homography(board[best], image[best]) if best.sum() >= 4 else fit_homography(board, image)


def twin(registered: DataFrame, by: str) -> DataFrame:
    """For each board its keyframes' number and median error, and the matrix of the best one."""
    good = registered.where("stage = 'ok'")
    return good.groupBy(by).agg(F.count("*").alias("n_keyframes"), F.median("residual_px").alias("median_reproj_px"), F.min_by("h", F.struct("residual_px", "frame")).alias("h"))
