"""The axis of every pair of classes, learnt without the fold that it scores."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import array_sums

#: Fixed value of the reference results: the share of variance that the principal axes keep.
KEEP = 0.95


@dataclass(frozen=True)
class Sums:
    """What all centrings and imputations of rows with gaps can be had from, about ``shift`` (d numbers).

    count[j, k]: rows where both features are there; value[j, k]: their sum of feature j;
    product[j, k]: their sum of j times k; n: all rows.
    """

    n: float
    shift: np.ndarray
    count: np.ndarray
    value: np.ndarray
    product: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Sums:
        there = np.isfinite(x)
        filled = np.where(there, x, 0.0)
        mask = there.astype(np.float64)
        seen = mask.sum(axis=0)
        shift = np.divide(filled.sum(axis=0), seen, out=np.zeros(x.shape[1]), where=seen > 0)
        z = np.where(there, x - shift, 0.0)
        return Sums(len(x), shift, mask.T @ mask, z.T @ mask, z.T @ z)

    def about(self, shift: np.ndarray) -> Sums:
        gap = self.shift - shift
        value = self.value + gap[:, None] * self.count
        product = self.product + gap[None, :] * self.value + gap[:, None] * self.value.T + np.outer(gap, gap) * self.count
        return Sums(self.n, shift, self.count, value, product)

    def plus(self, other: Sums, sign: float = 1.0) -> Sums:
        """Both sets of rows together, or this one without the other, which it holds."""
        o = other.about(self.shift)
        return Sums(self.n + sign * o.n, self.shift, self.count + sign * o.count, self.value + sign * o.value, self.product + sign * o.product)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n], self.shift, self.count.ravel(), self.value.ravel(), self.product.ravel()])

    @staticmethod
    def unflat(a: np.ndarray) -> Sums:
        d = int(round((np.sqrt(1 + 12 * (len(a) - 1)) - 1) / 6))
        parts = a[d + 1 :].reshape(3, d, d)
        return Sums(float(a[0]), a[1 : d + 1], *parts)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return Sums.unflat(a).plus(Sums.unflat(b)).flat()


def _cells(batches: Iterator[pa.RecordBatch], features: int) -> Iterable[tuple[str, np.ndarray]]:
    """The sums of each cell (fold and class) of a partition."""
    known: dict[str, Sums] = {}
    for batch in batches:
        cell = np.array(batch.column(0).to_pylist())
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]]).reshape(-1, features)
        for name in np.unique(cell):
            own = Sums.of(x[cell == name])
            known[name] = known[name].plus(own) if name in known else own
    return [(name, sums.flat()) for name, sums in known.items()]


@dataclass(frozen=True)
class PairAxis:
    """Means that stand in for missing features, and the axis in their units; ``kept`` principal axes carried it."""

    mean: np.ndarray
    axis: np.ndarray
    kept: int


def pair_axis(a: Sums, b: Sums, keep: float = KEEP, floor: np.ndarray | float = 0.0) -> PairAxis:
    """Impute by the mean, scale by the spread, keep the principal axes of ``keep`` of the variance, discriminate; all from sums.

    The score has a mean of 0, a spread of 1 within the classes and b on the positive side. A feature that
    is missing everywhere is 0, a spread of 0 is 1. Variances below ``floor``, which differences of sums leave over, are 0.
    """
    b = b.about(a.shift)
    n, both = a.n + b.n, a.plus(b)
    seen = np.diag(both.count)
    mean = np.divide(np.diag(both.value), seen, out=-a.shift.copy(), where=seen > 0)

    def product(s: Sums) -> np.ndarray:
        return s.product - mean[None, :] * s.value - mean[:, None] * s.value.T + np.outer(mean, mean) * s.count

    def centre(s: Sums) -> np.ndarray:
        return (np.diag(s.value) - mean * np.diag(s.count)) / s.n

    total = product(both)
    moves = (seen > 0) & (np.diag(total) / n > np.maximum(floor, 1e-24))
    spread = np.sqrt(np.diag(total) / n, out=np.ones(len(mean)), where=moves)
    total = np.where(np.outer(moves, moves), total, 0.0) / np.outer(spread, spread)
    centres = [np.where(moves, centre(s), 0.0) / spread for s in (a, b)]
    values, axes = np.linalg.eigh(total / n)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    most = max(1, min(int(n) - 1, len(mean)))
    kept = min(int(np.searchsorted(share, keep, side="right")) + 1, most)
    axes = axes[:, :kept]
    within = total - sum(s.n * np.outer(c, c) for s, c in zip((a, b), centres, strict=True))
    gap = axes.T @ (centres[1] - centres[0])
    way = np.linalg.pinv(axes.T @ within @ axes / max(n - 2, 1), hermitian=True) @ gap
    way = way / max(np.sqrt(max(way @ gap, 0)), 1e-12)
    return PairAxis(mean + a.shift, axes @ way / spread, kept)


def _there(column: Column) -> Column:
    return F.coalesce(F.abs(column) < float("inf"), F.lit(False))  # NaN is above all numbers


def pairwise_out_of_fold(df: DataFrame, label: str, features: Sequence[str], key: str, keep: float = KEEP) -> DataFrame:
    """V6: (key, fold, class_a, class_b, label, score, kept): each row on the axis of every pair of classes that it belongs to.

    For each fold and pair (a before b) a fresh chain (``pair_axis``) learns from the other folds' rows of these
    two; a pair that lacks a class there is skipped. One scan takes the sums of each fold and class, as a tree of
    partial sums; a fold's training sums are all rows' without the fold's, and every chain is solved from them.
    What is sent to the rows is a row a fold and pair. Missing and non-finite features count as the training rows' mean;
    rows without a label have no score.
    """
    names = df.where(F.col(label).isNotNull()).select("fold", label).distinct()
    cells = {f"{i}": (r[0], r[1]) for i, r in enumerate(names.orderBy("fold", label).collect())}  # folds x classes
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    tagged = df.sparkSession.createDataFrame([(k, *v) for k, v in cells.items()], f"__cell string, __fold {kinds['fold']}, __label {kinds[label]}")
    values = [F.when(_there(F.col(f).cast("double")), F.col(f).cast("double")).alias(f"__x{i}") for i, f in enumerate(features)]
    rows = df.join(F.broadcast(tagged), F.col("fold").eqNullSafe(F.col("__fold")) & (F.col(label) == F.col("__label"))).select("__cell", *values)
    sums = {cells[k]: Sums.unflat(v) for k, v in array_sums(rows, functools.partial(_cells, features=len(features)), _merged).items()}
    classes = sorted({c for _, c in sums})
    whole = {c: functools.reduce(Sums.plus, [s for (_, own), s in sums.items() if own == c]) for c in classes}
    everything = functools.reduce(Sums.plus, whole.values()) if whole else None
    axes = []
    for fold in dict.fromkeys(f for f, _ in cells.values()):
        train = {c: whole[c].plus(sums[fold, c], -1.0) if (fold, c) in sums else whole[c] for c in classes}
        held = [c for c in classes if train[c].n > 0.5]
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                found = pair_axis(train[a], train[b], keep, 1e-13 * np.diag(everything.product) / everything.n)
                axes.append((fold, a, b, found.mean.tolist(), found.axis.tolist(), found.kept))
    table = df.sparkSession.createDataFrame(axes, f"__fold {kinds['fold']}, class_a {kinds[label]}, class_b {kinds[label]}, mean array<double>, axis array<double>, kept int")
    met = df.join(table, F.col("fold").eqNullSafe(F.col("__fold")) & ((F.col(label) == F.col("class_a")) | (F.col(label) == F.col("class_b"))))
    parts = [F.when(_there(F.col(f).cast("double")), F.col("axis")[i] * (F.col(f).cast("double") - F.col("mean")[i])).otherwise(0.0) for i, f in enumerate(features)]
    return met.select(key, "fold", "class_a", "class_b", F.col(label).alias("label"), functools.reduce(Column.__add__, parts).alias("score"), "kept")
