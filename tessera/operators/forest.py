"""Random forests grown on counts: rows that fall into the same bins and have the same label are one cell, and trees are dealt to tasks.

Bins are all that a tree with binned splits sees of a row. A bootstrap that draws each row a Poisson number of times draws a
cell of n rows a Poisson number of times with mean n; so trees grown on cells follow the law of trees grown on rows, and past the
counting their work no longer grows with the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import array_sums, materialise

#: Numbers that a fold's cells may have in a task; tables with more cells are left to the learner of rows.
CELLS = 1 << 20
#: Nodes whose histograms a task holds at once.
_NODES = 2048


@dataclass(frozen=True)
class Cells:
    """What teaches a fold's model: bins (cells x features), label and rows of each cell; the bins that ask for a guess."""

    bins: np.ndarray
    label: np.ndarray
    n: np.ndarray
    asked: np.ndarray


@dataclass(frozen=True)
class Law:
    """How trees grow. ``weight`` has a number a class; where it is empty, labels are numbers to predict."""

    depth: int
    least: int
    take: int
    weight: np.ndarray


@dataclass
class Tree:
    """Nodes, parents before children: feature and last bin of the left side, the left child (-1 for a leaf; the right one follows it), what its rows add up to."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    total: np.ndarray


def _impurity(total: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity (Gini's, or the variance) of sums along the last axis."""
    if len(law.weight):
        w = total * law.weight
        n = w.sum(axis=-1)
        return n, 1 - (w**2).sum(axis=-1) / np.where(n > 0, n, 1.0) ** 2
    n = total[..., 0]
    safe = np.maximum(n, 1.0)
    return n, np.maximum(total[..., 2] / safe - (total[..., 1] / safe) ** 2, 0.0)


def _rows(total: np.ndarray, law: Law) -> np.ndarray:
    return total.sum(axis=-1) if len(law.weight) else total[..., 0]


def _best(at: np.ndarray, bins: np.ndarray, stats: np.ndarray, total: np.ndarray, widths: Sequence[int], law: Law, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of some nodes the gain, feature and cut of its best split; ``at`` has the node of each cell. The first of equals; no gain where no split is allowed."""
    m = len(total)
    gain, feature, cut = np.zeros(m), np.full(m, -1), np.full(m, -1)
    n, impurity = _impurity(total, law)
    drawn = rng.random((m, len(widths))).argsort(axis=1).argsort(axis=1) < law.take if law.take < len(widths) else np.ones((m, len(widths)), bool)
    for f, width in enumerate(widths):
        if width < 2:
            continue
        cell = at * width + bins[:, f]
        low = np.stack([np.bincount(cell, s, m * width) for s in stats.T], axis=-1).reshape(m, width, -1).cumsum(axis=1)[:, :-1]
        high = total[:, None] - low
        (n_low, i_low), (n_high, i_high) = _impurity(low, law), _impurity(high, law)
        won = impurity[:, None] - (n_low * i_low + n_high * i_high) / n[:, None]
        won[(_rows(low, law) < law.least) | (_rows(high, law) < law.least) | ~drawn[:, f, None]] = -1.0
        k = won.argmax(axis=1)
        top = won[np.arange(m), k]
        better = top > gain
        gain[better], feature[better], cut[better] = top[better], f, k[better]
    return gain, feature, cut


def grow(bins: np.ndarray, stats: np.ndarray, widths: Sequence[int], law: Law, rng: np.random.Generator) -> Tree:
    """A tree of cells whose ``stats`` (rows a class, or rows and sums of the number and its square) were drawn; level by level."""
    total = stats.sum(axis=0)[None]
    feature, cut, left, totals = [np.array([-1])], [np.array([-1])], [np.array([-1])], [total]
    pure = 1e-12 * max(1.0, float(_impurity(total, law)[1][0]))
    open_, at, made = np.array([0]), np.zeros(len(bins), np.int64), 1  # open nodes of the last level, each cell's place among them
    for _ in range(law.depth):
        open_ = open_[_impurity(totals[-1][open_], law)[1] > pure]
        place = np.full(len(totals[-1]), -1)
        place[open_] = np.arange(len(open_))
        at = place[at]
        bins, stats, at = bins[at >= 0], stats[at >= 0], at[at >= 0]
        if not len(open_):
            break
        found = [_best(at[own] - lo, bins[own], stats[own], totals[-1][open_[lo : lo + _NODES]], widths, law, rng) for lo in range(0, len(open_), _NODES) for own in [(at >= lo) & (at < lo + _NODES)]]
        gain, best, where = (np.concatenate(x) for x in zip(*found, strict=True))
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        nodes = open_[split]
        feature[-1][nodes], cut[-1][nodes], left[-1][nodes] = best[split], where[split], made + 2 * np.arange(len(split))
        place = np.full(len(open_), -1)
        place[split] = np.arange(len(split))
        at = place[at]
        bins, stats, at = bins[at >= 0], stats[at >= 0], at[at >= 0]
        right = bins[np.arange(len(bins)), best[split][at]] > where[split][at]
        at = 2 * at + right
        level = np.stack([np.bincount(at, s, 2 * len(split)) for s in stats.T], axis=-1)
        for parts, new in ((feature, -1), (cut, -1), (left, -1)):
            parts.append(np.full(len(level), new))
        totals.append(level)
        made += len(level)
        open_ = np.arange(len(level))
    return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(totals))


def pruned(tree: Tree, law: Law) -> Tree:
    """Two leaves of the same class become their parent's."""
    choice = (tree.total * law.weight).argmax(axis=1)
    left = tree.left.copy()
    for k in np.flatnonzero(left >= 0)[::-1]:
        a = left[k]
        if left[a] < 0 and left[a + 1] < 0 and choice[a] == choice[a + 1]:
            left[k] = -1
    return Tree(tree.feature, tree.cut, left, tree.total)


def votes(tree: Tree, bins: np.ndarray, law: Law) -> np.ndarray:
    """Shares of the classes, or the mean of the number, in the leaf of each row of ``bins`` (rows x classes, or x 1)."""
    at = np.zeros(len(bins), np.int64)
    while len(moving := np.flatnonzero(tree.left[at] >= 0)):
        node = at[moving]
        at[moving] = tree.left[node] + (bins[moving, tree.feature[node]] > tree.cut[node])
    w = tree.total[at]
    if len(law.weight):
        w = w * law.weight
        return w / w.sum(axis=1, keepdims=True)
    return w[:, 1:2] / w[:, :1]


def one_tree(cells: Cells, widths: Sequence[int], law: Law, rng: np.random.Generator) -> np.ndarray:
    """What a tree of a bootstrap of the rows behind ``cells`` says of the bins that ask."""
    drawn = rng.poisson(cells.n).astype(float)
    if not drawn.any():  # a few rows may all stay away
        drawn = cells.n.astype(float)
    own = drawn > 0
    if len(law.weight):
        stats = np.zeros((int(own.sum()), len(law.weight)))
        stats[np.arange(len(stats)), cells.label[own].astype(int)] = drawn[own]
    else:
        y = cells.label[own]
        stats = drawn[own, None] * np.stack([np.ones(len(y)), y, y * y], axis=1)
    tree = grow(cells.bins[own], stats, widths, law, rng)
    return votes(pruned(tree, law) if len(law.weight) else tree, cells.asked, law)


def _dealt_trees(batches: Iterator[pa.RecordBatch], taught: dict[int, Cells], widths: dict[int, list[int]], law: Law, seed: int) -> Iterable[tuple[str, np.ndarray]]:
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        for fold, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = one_tree(taught[fold], widths[fold], law, np.random.default_rng([seed, fold, tree])).ravel()
            known[str(fold)] = known[str(fold)] + own if str(fold) in known else own
    return known.items()


def _borders(rows: DataFrame, folds: Sequence, features: Sequence[str], bins: int) -> dict[int, list[list[float]]]:
    """For each fold and feature the borders between bins, of the other folds' rows: between all values if ``bins`` hold them, else at quantiles."""
    found: dict[int, list[list[float]]] = {k: [[] for _ in features] for k in range(len(folds))}
    many = []
    for j, f in enumerate(features):
        seen = rows.select("fold", f).distinct().limit(len(folds) * bins + 1).collect()
        sets = {k: np.unique([r[f] for r in seen if r.fold != fold]) for k, fold in enumerate(folds)}
        if len(seen) > len(folds) * bins or max(map(len, sets.values())) > bins:
            many.append(j)
        else:
            for k, v in sets.items():
                found[k][j] = ((v[1:] + v[:-1]) / 2).tolist()
    if many:
        shares = [i / bins for i in range(1, bins)]
        asked = [F.percentile_approx(F.when(F.col("fold") != fold, F.col(features[j])), shares, 10_000).alias(f"q{k}_{j}") for k, fold in enumerate(folds) for j in many]
        q = rows.agg(*asked).first()
        for k in range(len(folds)):
            for j in many:
                found[k][j] = np.unique(q[f"q{k}_{j}"] or []).tolist()
    return found


def _binned(rows: DataFrame, features: Sequence[str], borders: Sequence[Sequence[float]]) -> DataFrame:
    """``rows`` with the bin of each feature as __b0, __b1 and so on; a value on a border is in the bin above."""
    some = [j for j, b in enumerate(borders) if b]
    out = rows
    if some:
        out = Bucketizer(inputCols=[features[j] for j in some], outputCols=[f"__b{j}" for j in some], splitsArray=[[-np.inf, *borders[j], np.inf] for j in some]).transform(rows)
    return out.withColumns({f"__b{j}": F.col(f"__b{j}").cast("int") if b else F.lit(0) for j, b in enumerate(borders)})


def counted_forest(df: DataFrame, label: str, features: Sequence[str], key: str, trees: int, depth: int, bins: int, seed: int, classes: bool, least: int = 2) -> DataFrame | None:
    """M6, V5: (key, fold, truth, guess) of a forest for each fold, grown on the counts of the other folds' rows; None if a fold has more than ``CELLS`` numbers in its cells.

    A node asks for the root of the features' number (classes) or a third of them (numbers), rounded up. Classes weigh the reciprocal of their rows.
    Rows with a missing feature are left out; those without a label or a fold teach nothing, and where nothing teaches, guesses are null.
    The driver receives a fold's cells and its guesses by bins, never rows.
    """
    x = [f"__x{j}" for j in range(len(features))]
    rows = df.select(F.col(key).alias("__key"), "fold", F.col(label).alias("__y"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, x, strict=True)]).dropna(subset=x)
    rows = materialise(rows, "rows")
    folds = [r.fold for r in rows.where("fold is not null").select("fold").distinct().orderBy("fold").collect()]  # a handful
    if not folds:
        return rows.select(F.col("__key").alias(key), "fold", F.col("__y").alias("truth"), F.lit(None).cast("double").alias("guess"))
    borders = _borders(rows.where("__y is not null and fold is not null"), folds, x, bins)
    b = [f"__b{j}" for j in range(len(features))]
    parts = [_binned(rows.where("fold is not null"), x, borders[k]).groupBy(F.lit(k).alias("k"), *b, F.col("__y").cast("double").alias("y"), (F.col("fold") == fold).alias("own")).agg(F.count("*").alias("n")) for k, fold in enumerate(folds)]
    counts = materialise(functools.reduce(DataFrame.unionByName, parts), "cells")
    n_classes = int(counts.agg(F.max("y")).first()[0] or 0) + 1 if classes else 3
    most = counts.groupBy("k").count().agg(F.max("count")).first()[0]
    if most * max(len(features) + 3, n_classes) > CELLS:
        return None
    of_class = counts.where("k = 0 and y is not null").groupBy("y").agg(F.sum("n")).collect() if classes else []
    weight = np.zeros(n_classes if classes else 0)
    for y, n in of_class:
        weight[int(y)] = 1 / n
    take = int(np.ceil(len(features) ** 0.5 if classes else len(features) / 3)) if trees > 1 else len(features)
    law, taught, widths = Law(depth, least, take, weight), {}, {}
    for k in range(len(folds)):
        t = counts.where(F.col("k") == k).orderBy(*b, "y", "own").toArrow()  # in one order, for the draws
        at = np.stack([t.column(n).to_numpy() for n in b], axis=1).astype(np.int64)
        y, own = t.column("y").to_numpy(), t.column("own").to_numpy()
        teach = ~own & ~np.isnan(y)
        asked = np.unique(at[own], axis=0)
        if teach.any() and len(asked):
            taught[k] = Cells(at[teach], y[teach], t.column("n").to_numpy()[teach], asked)
            widths[k] = [len(v) + 1 for v in borders[k]]
    spark = df.sparkSession
    slices = min(max(1, trees * len(folds)), 4 * spark.sparkContext.defaultParallelism)
    jobs = spark.range(0, trees * len(folds), 1, slices).select((F.col("id") / trees).cast("int").alias("fold"), (F.col("id") % trees).cast("int").alias("tree")).where(F.col("fold").isin(list(taught)))
    sums = array_sums(jobs, functools.partial(_dealt_trees, taught=taught, widths=widths, law=law, seed=seed), partitions=slices)
    tables = []
    for k, cells in taught.items():
        # sums come in any order, so the last digits of equal shares may differ
        share = np.round(sums[str(k)].reshape(len(cells.asked), -1) / trees, 12)
        guess = share.argmax(axis=1).astype(float) if classes else share[:, 0]
        tables.append(pa.table({"__k": pa.array([k] * len(guess), pa.int32()), **{n: pa.array(c.astype(np.int32)) for n, c in zip(b, cells.asked.T, strict=True)}, "guess": pa.array(guess)}))
    empty = pa.table({"__k": pa.array([], pa.int32()), **{n: pa.array([], pa.int32()) for n in b}, "guess": pa.array([], pa.float64())})
    guesses = materialise(spark.createDataFrame(pa.concat_tables([empty, *tables])), "guesses")
    out = [_binned(rows.where(F.col("fold") == fold), x, borders[k]).join(guesses.where(F.col("__k") == k), b, "left") for k, fold in enumerate(folds)]
    return functools.reduce(DataFrame.unionByName, [part.select(F.col("__key").alias(key), "fold", F.col("__y").alias("truth"), "guess") for part in out])
