"""Linear models: sufficient statistics from one aggregate, a small solve on the driver, scores in the row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import forest, pairs


@dataclass(frozen=True)
class Moments:
    """Count, mean and scatter (sum of centred outer products) of each class; classes x features numbers."""

    classes: list
    n: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray


def gather_moments(df: DataFrame, label: str, features: Sequence[str]) -> Moments:
    """One aggregate by class: counts, means and covariances (d * d numbers a class); rows with a missing feature are left out."""
    rows = df.where(F.col(label).isNotNull()).dropna(subset=list(features))
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    found = rows.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"s{i}_{j}") for i, j in pairs]).orderBy("c").collect()
    d = len(features)
    scatter = np.zeros((len(found), d, d))
    for k, r in enumerate(found):
        for i, j in pairs:
            scatter[k, i, j] = scatter[k, j, i] = r[f"s{i}_{j}"] * r.n
    return Moments([r.c for r in found], np.array([r.n for r in found], float), np.array([[r[f"m{i}"] for i in range(d)] for r in found]).reshape(-1, d), scatter)


def _signed(axes: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    at = np.abs(axes).argmax(axis=0)
    return axes * np.where(axes[at, np.arange(axes.shape[1])] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Projection:
    """Centre, axes (features x k) and the share of variance of each axis."""

    features: list[str]
    centre: np.ndarray
    axes: np.ndarray
    share: np.ndarray

    def columns(self, name: str) -> list[Column]:
        """Each axis as a column; null if a feature is missing."""
        return [sum((F.lit(float(w)) * (F.col(f) - F.lit(float(c))) for f, w, c in zip(self.features, axis, self.centre, strict=True)), F.lit(0.0)).alias(f"{name}{k + 1}") for k, axis in enumerate(self.axes.T)]

    def loadings(self) -> list[tuple[str, int, float]]:
        """M4, O2: (feature, axis, weight), the heaviest first on each axis."""
        return [(self.features[i], k + 1, float(self.axes[i, k])) for k in range(self.axes.shape[1]) for i in np.argsort(-np.abs(self.axes[:, k]), kind="stable")]


def pca(df: DataFrame, features: Sequence[str], keep: float | int = 0.95) -> Projection:
    """M2: axes of population z-scores that keep a share of the variance (or so many axes)."""
    m = gather_moments(df.withColumn("__all", F.lit(1)), "__all", features)
    spread = np.sqrt(np.diag(m.scatter[0]) / m.n[0])
    spread = np.where(spread > 1e-12, spread, 1.0)
    values, axes = np.linalg.eigh(m.scatter[0] / m.n[0] / np.outer(spread, spread))
    values, axes = np.maximum(values[::-1], 0), _signed(axes[:, ::-1])
    share = values / max(values.sum(), 1e-12)
    k = keep if isinstance(keep, int) else int(np.searchsorted(np.cumsum(share), keep - 1e-12) + 1)
    return Projection(list(features), m.mean[0], axes[:, :k] / spread[:, None], share[:k])


@dataclass(frozen=True)
class Discriminant:
    """M3: a linear discriminant: one score a class, the largest wins."""

    features: list[str]
    classes: list
    weights: np.ndarray
    bias: np.ndarray
    axes: Projection

    def predict(self) -> Column:
        """The class of the largest score, the first of equals; null if a feature is missing."""
        def score(weights: np.ndarray, bias: float) -> Column:
            return sum((F.lit(float(w)) * F.col(f) for f, w in zip(self.features, weights, strict=True)), F.lit(float(bias)))

        scores = [F.struct((-score(w, b)).alias("s"), F.lit(k).alias("order"), F.lit(c).alias("c")) for k, (w, b, c) in enumerate(zip(self.weights, self.bias, self.classes, strict=True))]
        whole = F.expr(" and ".join(f"`{f}` is not null" for f in self.features))
        return F.when(whole, F.array_min(F.array(*scores))["c"])


def lda(m: Moments, features: Sequence[str]) -> Discriminant:
    """M3: classes of equal covariance and observed priors; a pseudo-inverse stands in where the scatter is singular."""
    total = m.n.sum()
    within = m.scatter.sum(axis=0) / max(total - len(m.classes), 1)
    inverse = np.linalg.pinv(within, hermitian=True)
    weights = m.mean @ inverse
    bias = -0.5 * np.einsum("ij,ij->i", weights, m.mean) + np.log(m.n / total)
    centre = (m.n[:, None] * m.mean).sum(axis=0) / total
    between = (m.mean - centre).T @ np.diag(m.n) @ (m.mean - centre) / total
    half = _half(inverse)
    values, axes = np.linalg.eigh(half @ between @ half)
    k = min(len(m.classes) - 1, len(features))
    values, axes = np.maximum(values[::-1][:k], 0), _signed(half @ axes[:, ::-1][:, :k])
    return Discriminant(list(features), m.classes, weights, bias, Projection(list(features), centre, axes, values / max(values.sum(), 1e-12)))


def _half(matrix: np.ndarray) -> np.ndarray:
    values, axes = np.linalg.eigh(matrix)
    return axes @ np.diag(np.sqrt(np.maximum(values, 0))) @ axes.T


def less(m: Moments, other: Moments) -> Moments:
    """V5: the moments of all rows without those of a part: exact, so a fold's training model needs no second pass."""
    at = {c: k for k, c in enumerate(other.classes)}
    n, mean, scatter = m.n.copy(), m.mean.copy(), m.scatter.copy()
    for k, c in enumerate(m.classes):
        if c in at:
            j = at[c]
            rest = m.n[k] - other.n[j]
            if rest <= 0:
                n[k] = 0
                continue
            mean[k] = (m.n[k] * m.mean[k] - other.n[j] * other.mean[j]) / rest
            gap = other.mean[j] - mean[k]
            scatter[k] = m.scatter[k] - other.scatter[j] - rest * other.n[j] / m.n[k] * np.outer(gap, gap)
            n[k] = rest
    keep = np.flatnonzero(n > 0)
    return Moments([m.classes[k] for k in keep], n[keep], mean[keep], scatter[keep])


def lda_out_of_fold(df: DataFrame, label: str, features: Sequence[str], key: str) -> DataFrame:
    """(key, fold, truth, guess): each fold scored by the model of all other folds."""
    whole = gather_moments(df, label, features)
    folds = [r.fold for r in df.select("fold").distinct().orderBy("fold").collect()]  # a handful
    parts = gather_moments(df.withColumn("__fc", F.struct("fold", F.col(label).alias("c"))).where(F.col(label).isNotNull()), "__fc", features)
    guess = F
    for fold in folds:
        at = [k for k, c in enumerate(parts.classes) if c["fold"] == fold]
        own = Moments([parts.classes[k]["c"] for k in at], parts.n[at], parts.mean[at], parts.scatter[at])
        guess = guess.when(F.col("fold") == fold, lda(less(whole, own), features).predict())
    return df.select(key, "fold", F.col(label).alias("truth"), guess.alias("guess"))


def shrunk_covariance(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """M9: mean, covariance shrunk towards a multiple of the identity, and the shrinkage in [0, 1].

    The shrinkage needs the covariance and the mean of |x - mean|^4: two aggregates.
    """
    m = gather_moments(df.withColumn("__all", F.lit(1)), "__all", features)
    n, d, cov = m.n[0], len(features), m.scatter[0] / m.n[0]
    mu = np.trace(cov) / d
    far = sum(((F.col(f) - F.lit(float(c))) ** 2 for f, c in zip(features, m.mean[0], strict=True)), F.lit(0.0))
    fourth = df.dropna(subset=list(features)).agg(F.avg(far * far)).first()[0]
    delta = ((cov - mu * np.eye(d)) ** 2).sum()
    beta = min((fourth - (cov**2).sum()) / n, delta)
    share = 0.0 if delta == 0 else float(max(0.0, beta / delta))
    return m.mean[0], (1 - share) * cov + share * mu * np.eye(d), share


def mahalanobis_column(features: Sequence[str], mean: np.ndarray, covariance: np.ndarray) -> Column:
    """distance of the row from a mean under a covariance; null if a feature is missing."""
    inverse = np.linalg.pinv(covariance, hermitian=True)
    d = [F.col(f) - F.lit(float(c)) for f, c in zip(features, mean, strict=True)]
    square = sum((F.lit(float(inverse[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def bimodality(df: DataFrame, value: str, rounds: int = 60) -> dict[str, float | bool]:
    """BIC of one and of two Gaussians, and whether two are better by 6, each heavier than 0.15 and over one spread apart.

    Expectation maximisation starts at the quartiles; a round is one aggregate of seven sums.
    """
    x = F.col("x")
    rows = df.select(F.col(value).cast("double").alias("x")).dropna()
    n, spread, low, high = rows.agg(F.count("*"), F.var_pop("x"), F.percentile("x", 0.25), F.percentile("x", 0.75)).first()
    one = -0.5 * n * (float(np.log(2 * np.pi * spread)) + 1)  # one Gaussian's likelihood is closed
    weights, means, spreads, two = [0.5, 0.5], [low, high], [spread / 4, spread / 4], -np.inf
    for _ in range(rounds):
        parts = [F.lit(w / (2 * np.pi * v) ** 0.5) * F.exp(-((x - m) ** 2) / (2 * v)) + 1e-300 for w, m, v in zip(weights, means, spreads, strict=True)]
        share = parts[0] / (parts[0] + parts[1])
        r = rows.agg(*[F.sum(c) for c in (share, share * x, share * x * x, x, x * x, F.ln(parts[0] + parts[1]))]).first()
        for k, (w, s, q) in enumerate(((r[0], r[1], r[2]), (n - r[0], r[3] - r[1], r[4] - r[2]))):
            w = max(w, 1e-9)
            weights[k], means[k], spreads[k] = w / n, s / w, max(q / w - (s / w) ** 2, 1e-6 * spread)
        if r[5] - two < 1e-7 * abs(r[5]):
            break
        two = r[5]
    bic = [-2 * likelihood + p * float(np.log(n)) for likelihood, p in ((one, 2), (two, 5))]
    apart = abs(means[0] - means[1]) / (0.5 * (spreads[0] ** 0.5 + spreads[1] ** 0.5))
    return {"bic_1": bic[0], "bic_2": bic[1], "least_weight": min(weights), "separation": apart, "bimodal": bool(bic[0] - bic[1] > 6 and min(weights) > 0.15 and apart > 1)}


def pairwise_out_of_fold(df: DataFrame, label: str, features: Sequence[str], key: str) -> DataFrame:
    """V6 without imputation and principal axes (``pairs`` has the whole chain): (key, fold, class_a, class_b, label, score); a row with a missing feature has no score and teaches nothing."""
    return pairs.pairwise_out_of_fold(df.dropna(subset=list(features)), label, features, key, keep=1.0).drop("kept")


def pairwise_dprime(scores: DataFrame) -> DataFrame:
    """V6, A4: (class_a, class_b, n, dprime) of the scores of all folds together; null without spread."""
    a, b = (F.when(F.col("label") == F.col(c), F.col("score")) for c in ("class_a", "class_b"))
    spread = F.sqrt(0.5 * (F.coalesce(F.var_samp(a), F.lit(0.0)) + F.coalesce(F.var_samp(b), F.lit(0.0))))
    return scores.groupBy("class_a", "class_b").agg(F.count("score").alias("n"), F.when(spread >= 1e-12, F.abs(F.avg(a) - F.avg(b)) / spread).alias("dprime"))


def third_axis(scalings: np.ndarray) -> int:
    """M5: of the principal axes (rows, the widest first) the one to show beside the discriminant's axes (columns).

    A fixed rule of the reference results: each is charged its rank, and its length in the discriminant relative to the longest times their number; the least charge, the first of equals.
    """
    use = np.linalg.norm(scalings, axis=1)
    return int(np.argmin(np.arange(len(use)) + use / (use.max() + 1e-12) * len(use)))


def view_axes(df: DataFrame, label: str, features: Sequence[str], keep: float | int = 0.95) -> tuple[DataFrame, int]:
    """M5, O1: ``df`` with columns view1, view2 (discriminant axes) and view3 (a principal axis), and that axis's number from 0."""
    main = pca(df, features, keep)
    names = [f"__pc{k + 1}" for k in range(main.axes.shape[1])]
    placed = df.select("*", *main.columns("__pc"))
    axes = lda(gather_moments(placed, label, names), names).axes
    axes = Projection(names, axes.centre, axes.axes[:, :2], axes.share[:2])
    third = third_axis(axes.axes)
    return placed.select(*df.columns, *axes.columns("view"), F.col(names[third]).alias("view3")), third


def out_of_fold(df: DataFrame, label: str, features: Sequence[str], key: str, learner: Estimator) -> DataFrame:
    """V5: (key, fold, truth, guess): each fold's rows as predicted by ``learner`` fitted on the rows of all other folds.

    ``learner`` reads the columns features and ``label``, and __w, the reciprocal size of the row's class. Rows with a missing feature are left out.
    """
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    counts = rows.groupBy(label).agg((F.lit(1.0) / F.count("*")).alias("__w"))
    weighted = rows.join(counts, label)
    out = None
    for r in df.select("fold").distinct().orderBy("fold").collect():  # a handful
        model = learner.fit(weighted.where(F.col("fold") != r.fold))
        part = model.transform(rows.where(F.col("fold") == r.fold)).select(key, "fold", F.col(label).alias("truth"), F.col("prediction").alias("guess"))
        out = part if out is None else out.unionByName(part)
    return out


def forest_out_of_fold(df: DataFrame, label: str, features: Sequence[str], key: str, trees: int = 300, depth: int = 20, bins: int = 64, seed: int = 7) -> DataFrame:
    """M6, V5: out-of-fold predictions of a random forest with balanced class weights; labels are integers from 0. Leaves hold two rows or more.

    Grown on counts (``forest``); where rows share too few bins for that, by Spark's learner on rows.
    """
    found = forest.counted_forest(df, label, features, key, trees, depth, bins, seed, classes=True)
    if found is None:
        learner = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="__w", numTrees=trees, maxDepth=depth, maxBins=bins, minInstancesPerNode=2, seed=seed)
        found = out_of_fold(df, label, features, key, learner)
    return found.withColumn("guess", F.col("guess").cast("int"))


def forest_values_out_of_fold(df: DataFrame, target: str, features: Sequence[str], key: str, trees: int = 300, depth: int = 20, bins: int = 64, seed: int = 7) -> DataFrame:
    """M6, V5: the same with a forest that predicts numbers."""
    found = forest.counted_forest(df, target, features, key, trees, depth, bins, seed, classes=False)
    if found is None:
        found = out_of_fold(df, target, features, key, RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, maxBins=bins, minInstancesPerNode=2, seed=seed))
    return found
