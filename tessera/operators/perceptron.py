"""Perceptrons that predict numbers or classes: gradients summed over partitions, the optimiser on the driver."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Generator, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import array_sums, dealt, materialise

#: Fixed values of the reference results: hidden layers and the penalty on squared weights.
HIDDEN, PENALTY = (128, 64), 1e-3


def shapes(sizes: Sequence[int]) -> list[tuple[int, int]]:
    """Weights of each layer, with a last row for the bias."""
    return [(a + 1, b) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]


def start(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Flat weights, uniform within the square root of 6 over a layer's ends; biases 0."""
    rng, parts = np.random.default_rng(seed), []
    for a, b in shapes(sizes):
        bound = np.sqrt(6 / (a - 1 + b))
        parts.append(np.vstack([rng.uniform(-bound, bound, (a - 1, b)), np.zeros((1, b))]).ravel())
    return np.concatenate(parts)


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    found, at = [], 0
    for a, b in shapes(sizes):
        found.append(weights[at : at + a * b].reshape(a, b))
        at += a * b
    return found


def _outputs(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Each layer's input, and the prediction at the end."""
    found = [x]
    for k, w in enumerate(layers):
        x = x @ w[:-1] + w[-1]
        x = np.maximum(x, 0) if k < len(layers) - 1 else x
        found.append(x)
    return found


def predict(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> np.ndarray:
    return _outputs(_layers(weights, sizes), x)[-1][:, 0]


def gradient_sums(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half the squared errors' sum, the rows, and the sum of the gradients; sums of batches add up."""
    layers = _layers(weights, sizes)
    seen = _outputs(layers, x)
    off = seen[-1] - y[:, None]
    total, back = [], off
    for k in range(len(layers) - 1, -1, -1):
        total.append(np.vstack([seen[k].T @ back, back.sum(axis=0)]).ravel())
        if k:
            back = (back @ layers[k][:-1].T) * (seen[k] > 0)
    return np.concatenate([[0.5 * float((off * off).sum()), len(x)], *total[::-1]])


def penalised(total: np.ndarray, weights: np.ndarray, sizes: Sequence[int], penalty: float) -> tuple[float, np.ndarray]:
    """Mean loss and gradient of all rows, with the penalty on weights that are no biases."""
    n = max(total[1], 1.0)
    bare = np.concatenate([np.vstack([w[:-1], np.zeros((1, w.shape[1]))]).ravel() for w in _layers(weights, sizes)])
    return float(total[0] / n + penalty / 2 * (bare @ bare) / n), (total[2:] + penalty * bare) / n


class SignSteps:
    """Resilient steps: each weight moves against its gradient's sign, further while the sign stays, half as far once it turns."""

    def __init__(self, n: int, first: float = 0.01, least: float = 1e-6, most: float = 0.5) -> None:
        self.size, self.before, self.bounds = np.full(n, first), np.zeros(n), (least, most)

    def moved(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        turn = gradient * self.before
        self.size = np.clip(self.size * np.where(turn > 0, 1.2, np.where(turn < 0, 0.5, 1.0)), *self.bounds)
        gradient = np.where(turn < 0, 0.0, gradient)
        self.before = gradient
        return weights - np.sign(gradient) * self.size


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folds, numbers to predict, features (rows x features) of a batch of whole rows."""
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    return np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False), x.reshape(batch.num_rows, -1)


def _scales(batches: Iterator[pa.RecordBatch]) -> Iterable[tuple[str, np.ndarray]]:
    """For each fold the rows, means and squared distances from them of the features and, last, of the number to predict."""
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        fold, y, x = _unpacked(batch)
        for f in np.unique(fold):
            z = np.column_stack([x, y])[fold == f]
            own = np.concatenate([[len(z)], z.mean(axis=0), ((z - z.mean(axis=0)) ** 2).sum(axis=0)])
            known[f] = merged_scales(known[f], own) if f in known else own
    return known.items()


def merged_scales(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and squared distances of two sets of rows together."""
    d, n = (len(a) - 1) // 2, a[0] + b[0]
    gap = b[1 : d + 1] - a[1 : d + 1]
    return np.concatenate([[n], a[1 : d + 1] + gap * b[0] / n, a[d + 1 :] + b[d + 1 :] + gap**2 * a[0] * b[0] / n])


def _centres(parts: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each fold mean and spread of all rows outside of it (a spread of 0 is 1); folds that hold all rows are left out."""
    found = {}
    for fold in parts:
        rest = [p for f, p in parts.items() if f != fold]
        if rest:
            whole = functools.reduce(merged_scales, rest)
            d = (len(whole) - 1) // 2
            spread = np.sqrt(whole[d + 1 :] / whole[0])
            found[fold] = whole[1 : d + 1], np.where(spread > 1e-12, spread, 1.0)
    return found


def _gradients(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], weights: dict[str, np.ndarray], centres: dict) -> Iterable[tuple[str, np.ndarray]]:
    """For each fold the gradient sums of its model over this partition's rows of the other folds."""
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        fold, y, x = _unpacked(batch)
        for f, w in weights.items():
            mean, spread = centres[f]
            z = (np.column_stack([x, y])[fold != f] - mean) / spread
            if len(z):
                own = gradient_sums(w, sizes, z[:, :-1], z[:, -1])
                known[f] = known[f] + own if f in known else own
    return known.items()


def fit_folds(rows: DataFrame, sizes: Sequence[int], rounds: int, penalty: float, seed: int) -> tuple[dict[str, np.ndarray], dict]:
    """Weights and centres of each fold's model, learnt from the rows (fold, truth, x) of the other folds.

    All folds' models take a step in one pass over the rows; the driver holds the weights, of a size that the layers set.
    """
    partitions = rows.rdd.getNumPartitions()
    centres = _centres(array_sums(rows, _scales, merged_scales, partitions=partitions))
    weights = {f: start(sizes, seed) for f in centres}
    steps = {f: SignSteps(len(w)) for f, w in weights.items()}
    for _ in range(rounds if weights else 0):
        totals = array_sums(rows, functools.partial(_gradients, sizes=sizes, weights=weights, centres=centres), partitions=partitions)
        for f, total in totals.items():
            weights[f] = steps[f].moved(weights[f], penalised(total, weights[f], sizes, penalty)[1])
    return weights, centres


def _guessed(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], weights: dict[str, np.ndarray], centres: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold, y, x = _unpacked(batch)
        guess = np.full(len(fold), np.nan)
        for f, w in weights.items():
            at = fold == f
            mean, spread = centres[f]
            if at.any():
                guess[at] = predict(w, sizes, (x[at] - mean[:-1]) / spread[:-1]) * spread[-1] + mean[-1]
        yield pa.record_batch([batch.column(3), pa.array(y), pa.array(guess, mask=np.isnan(guess))], ["row", "truth", "guess"])


def perceptron_values_out_of_fold(df: DataFrame, target: str, features: Sequence[str], key: str, hidden: Sequence[int] = HIDDEN, rounds: int = 150, penalty: float = PENALTY, seed: int = 7) -> DataFrame:
    """M7, V5: (key, fold, truth, guess): each row's number as predicted by a perceptron of the other folds' rows.

    Features and the number are scaled by the training rows' means and spreads. Layers are rectified, the last is
    linear; the loss is half the mean squared error and a penalty on the weights. Rows without a number or with a
    missing or non-finite feature are left out; a fold outside of which there is no row has null guesses.
    """
    whole = [F.col(c).cast("double") for c in (target, *features)]
    finite = functools.reduce(lambda a, b: a & b, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in whole])  # NaN is above all numbers
    rows = df.where(finite).select(F.coalesce(F.col("fold").cast("string"), F.lit("")).alias("fold"), whole[0].alias("truth"), F.array(*whole[1:]).alias("x"), F.struct(F.col(key), F.col("fold")).alias("row"))
    rows = materialise(rows, "rows")
    sizes = [len(features), *hidden, 1]
    weights, centres = fit_folds(rows.select("fold", "truth", "x"), sizes, rounds, penalty, seed)
    kinds = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(functools.partial(_guessed, sizes=sizes, weights=weights, centres=centres), f"row {kinds}, truth double, guess double")
    return found.select(f"row.{key}", "row.fold", "truth", "guess")


# --- classes: logistic hidden layers, softmax at the end, limited-memory BFGS

#: Rows whose activations are held at once, and distinct rows in a task.
_BLOCK, _DEALT = 2048, 20_000


def start_classes(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Flat weights and biases, uniform within 2.4 over a layer's inputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, a * b) / (a - 1) for a, b in shapes(sizes)])


def _activations(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Each layer's input, and the logits at the end."""
    found = [x]
    for k, w in enumerate(layers):
        x = x @ w[:-1]
        x += w[-1]
        if k < len(layers) - 1:
            np.negative(x, x)
            with np.errstate(over="ignore"):  # far below zero the logistic function is 0
                np.exp(x, x)
            x += 1
            np.reciprocal(x, x)
        found.append(x)
    return found


def class_sums(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over rows that stand for ``n`` equal ones each: the cross-entropy of the classes ``y``, the rows, the gradients."""
    layers = _layers(weights, sizes)
    out = np.zeros(2 + len(weights))
    for lo in range(0, len(x), _BLOCK):
        own, m = y[lo : lo + _BLOCK], n[lo : lo + _BLOCK]
        seen, rows = _activations(layers, x[lo : lo + _BLOCK]), np.arange(len(own))
        logits = seen[-1] - seen[-1].max(axis=1, keepdims=True)
        share = np.exp(logits)
        total = share.sum(axis=1)
        out[0] += m @ (np.log(total) - logits[rows, own])
        out[1] += m.sum()
        back = share / total[:, None]
        back[rows, own] -= 1
        back *= m[:, None]
        at = len(out)
        for k in range(len(layers) - 1, -1, -1):
            size = layers[k].size
            out[at - size : at] += np.vstack([seen[k].T @ back, back.sum(axis=0)]).ravel()
            at -= size
            if k:
                back = back @ layers[k][:-1].T
                back *= seen[k]
                back *= 1 - seen[k]
    return out


def descent(weights: np.ndarray, rounds: int, tolerance: float = 1e-6, pairs: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS: yields weights, is sent their loss and gradient, returns the last weights of at most ``rounds`` steps.

    Steps meet the weak Wolfe conditions. It ends where losses of the last twenty rounds are within ``tolerance`` of the first loss, or the gradient is as small.
    """
    loss, gradient = yield weights
    first, losses, known = abs(loss), deque([loss], 20), deque(maxlen=pairs)
    for round_ in range(rounds):
        if np.linalg.norm(gradient) <= max(tolerance * abs(loss), 1e-8):
            break
        way, used = -gradient, []
        for s, t, rho in reversed(known):
            used.append(rho * (s @ way))
            way = way - used[-1] * t
        if known:
            s, t, rho = known[-1]
            way = way / (rho * (t @ t))
        for (s, t, rho), a in zip(known, reversed(used), strict=True):
            way = way + (a - rho * (t @ way)) * s
        slope = gradient @ way
        if slope >= 0:
            known.clear()
            way, slope = -gradient, -(gradient @ gradient)
        low, high, step = 0.0, np.inf, 1.0 if round_ else 1 / np.linalg.norm(gradient)
        for _ in range(20):
            tried = weights + step * way
            new, turned = yield tried
            if not new <= loss + 1e-4 * step * slope:
                high = step
            elif turned @ way < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * low
        if not new < loss:
            break
        t = turned - gradient
        if t @ (tried - weights) > 0:
            known.append((tried - weights, t, 1 / (t @ (tried - weights))))
        weights, loss, gradient = tried, new, turned
        if max(losses) - loss <= tolerance * first:
            break
        losses.append(loss)
    return weights


def _wide(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _class_gradients(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], weights: dict[int, np.ndarray]) -> Iterable[tuple[str, np.ndarray]]:
    """For each fold the sums of its model over this partition's rows of the other folds."""
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        fold, y, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        x = _wide(batch.column(3), batch.num_rows)
        for f, w in weights.items():
            other = fold != f
            if other.any():
                own = class_sums(w, sizes, x[other], y[other], n[other])
                known[str(f)] = known[str(f)] + own if str(f) in known else own
    return known.items()


def fit_class_folds(rows: DataFrame, sizes: Sequence[int], rounds: int, seed: int, folds: Sequence[int]) -> dict[int, np.ndarray]:
    """Weights of each fold's model, learnt from the rows (fold, y, n, x) of the other folds; folds outside of which there is no row have none.

    The models that still move are tried in one pass over the rows; the driver holds weights and the optimiser's last steps, of a size that the layers set.
    """
    partitions = rows.rdd.getNumPartitions()
    running = {f: descent(start_classes(sizes, seed), rounds) for f in folds}
    tried, found = {f: next(g) for f, g in running.items()}, {}
    while tried:
        totals = array_sums(rows, functools.partial(_class_gradients, sizes=sizes, weights=tried), partitions=partitions)
        after = {}
        for f in tried:
            if str(f) in totals:
                total = totals[str(f)]
                try:
                    after[f] = running[f].send((total[0] / total[1], total[2:] / total[1]))
                except StopIteration as end:
                    found[f] = end.value
        tried = after
    return found


def _class_guesses(batches: Iterator[pa.RecordBatch], sizes: Sequence[int], weights: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold, x = batch.column(1).to_numpy(zero_copy_only=False), _wide(batch.column(2), batch.num_rows)
        guess = np.full(len(fold), -1, np.int32)
        for f, w in weights.items():
            layers, at = _layers(w, sizes), np.flatnonzero(fold == f)
            for lo in range(0, len(at), _BLOCK):
                guess[at[lo : lo + _BLOCK]] = _activations(layers, x[at[lo : lo + _BLOCK]])[-1].argmax(axis=1)
        yield pa.record_batch([batch.column(0), pa.array(guess, mask=guess < 0)], ["row", "guess"])


def perceptron_out_of_fold(df: DataFrame, label: str, features: Sequence[str], key: str, hidden: Sequence[int] = HIDDEN, rounds: int = 200, seed: int = 7) -> DataFrame:
    """M7, V5: (key, fold, truth, guess): each row's class (an integer from 0) as predicted by a perceptron of the other folds' rows; features ought to be z-scores.

    The loss is the mean cross-entropy of all rows. Rows that are equal in fold, class and features teach as one that counts as often, which is the same sum.
    Rows with a missing or non-finite feature are left out, rows without a class teach nothing; a fold outside of which there is no row has null guesses.
    """
    x = [F.col(c).cast("double") for c in features]
    finite = functools.reduce(lambda a, b: a & b, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in x])  # NaN is above all numbers
    folds = [r.fold for r in df.where("fold is not null").select("fold").distinct().orderBy("fold").collect()]  # a handful
    number = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")) if folds else F.lit(0)
    row = F.struct(F.col(key), F.col("fold"), F.col(label).alias("truth"))
    rows = materialise(df.where(finite).select(row.alias("row"), F.coalesce(number, F.lit(0)).cast("int").alias("number"), F.array(*x).alias("x")), "rows")
    taught = rows.where("row.truth is not null and number > 0").groupBy("number", F.col("row.truth").cast("int").alias("y"), "x").agg(F.count("*").cast("double").alias("n"))
    taught = materialise(dealt(materialise(taught, "distinct").select("number", "y", "n", "x"), _DEALT), "taught")
    classes = (taught.agg(F.max("y")).first()[0] or 0) + 1
    sizes = [len(features), *hidden, max(classes, 2)]
    weights = fit_class_folds(taught, sizes, rounds, seed, range(1, len(folds) + 1))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(functools.partial(_class_guesses, sizes=sizes, weights=weights), f"row {kind}, guess int")
    return found.select(f"row.{key}", "row.fold", "row.truth", "guess")
