"""Sums as a tree, the perceptron for numbers and pair axes against NumPy."""

import functools

import numpy as np
import pytest

from tessera.operators import models, pairs
from tessera.operators import perceptron as P
from tessera.plans import array_sums


def count_by_parity(batches):
    known = {}
    for batch in batches:
        for v in batch.column(0).to_pylist():
            name = "odd" if v % 2 else "even"
            known[name] = known.get(name, np.zeros(2)) + [1, v]
    return known.items()


@pytest.mark.parametrize("partitions,fan", [(1, 64), (9, 64), (9, 2)])
def test_array_sums(spark, partitions, fan):
    found = array_sums(spark.range(0, 101, 1, partitions), count_by_parity, fan=fan)
    assert {k: v.tolist() for k, v in found.items()} == {"even": [51, sum(range(0, 101, 2))], "odd": [50, sum(range(1, 101, 2))]}
    assert array_sums(spark.range(0), count_by_parity) == {}


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    sizes = [3, 5, 4, 1]
    w = P.start(sizes, 1) + rng.normal(0, 0.1, len(P.start(sizes, 1)))
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    loss = lambda v: P.penalised(P.gradient_sums(v, sizes, x, y), v, sizes, 0.1)[0]
    gradient = P.penalised(P.gradient_sums(w, sizes, x, y), w, sizes, 0.1)[1]
    slopes = [(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6]
    assert np.allclose(gradient, slopes, atol=1e-6)
    parts = P.gradient_sums(w, sizes, x[:7], y[:7]) + P.gradient_sums(w, sizes, x[7:], y[7:])
    assert np.allclose(parts, P.gradient_sums(w, sizes, x, y))


def numpy_twin(rows, sizes, rounds, penalty, seed):
    """rows: (key, fold, y, x...); whole arrays, one fold after the other."""
    a = np.array([r[2:] for r in rows], float)
    folds, out = np.array([r[1] for r in rows]), {}
    for fold in np.unique(folds):
        train = a[folds != fold]
        mean, spread = train.mean(axis=0), train.std(axis=0)
        spread = np.where(spread > 1e-12, spread, 1.0)
        z, w = (train - mean) / spread, P.start(sizes, seed)
        steps = P.SignSteps(len(w))
        for _ in range(rounds):
            w = steps.moved(w, P.penalised(P.gradient_sums(w, sizes, z[:, 1:], z[:, 0]), w, sizes, penalty)[1])
        for r, x in zip([r for r in rows if r[1] == fold], a[folds == fold], strict=True):
            out[r[0]] = float(P.predict(w, sizes, ((x[1:] - mean[1:]) / spread[1:])[None, :])[0] * spread[0] + mean[0])
    return out


def test_perceptron_for_numbers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a, b = rng.uniform(-2, 2, 2)
        rows.append((i, i % 3, float(np.sin(2 * a) + b * b + 5), float(a), float(b), 4.0))
    odd = [(900, 0, None, 1.0, 1.0, 4.0), (901, 1, 1.0, None, 1.0, 4.0), (902, 2, 1.0, float("nan"), 1.0, 4.0), (903, 2, 1.0, float("inf"), 1.0, 4.0)]
    df = spark.createDataFrame(rows + odd, "id int, fold int, y double, a double, b double, flat double").repartition(5)
    found = {r.id: r for r in P.perceptron_values_out_of_fold(df, "y", ["a", "b", "flat"], "id", hidden=(24, 12), rounds=40).collect()}
    assert sorted(found) == list(range(300))
    twin = numpy_twin(rows, [3, 24, 12, 1], 40, P.PENALTY, 7)
    assert np.allclose([found[i].guess for i in range(300)], [twin[i] for i in range(300)], atol=1e-4)
    off = np.mean([(found[i].guess - found[i].truth) ** 2 for i in range(300)])
    assert off < 0.1 * np.var([r[2] for r in rows])
    assert P.perceptron_values_out_of_fold(df.limit(0), "y", ["a"], "id").count() == 0
    alone = P.perceptron_values_out_of_fold(df.where("fold = 1"), "y", ["a"], "id", rounds=2)
    assert alone.count() == 100 and alone.where("guess is not null").count() == 0


def chain(xa, xb, keep=0.95):
    """Impute, scale, reduce, discriminate on whole arrays."""
    x = np.vstack([xa, xb])
    there = np.isfinite(x)
    mean = np.array([c[t].mean() if t.any() else 0.0 for c, t in zip(x.T, there.T, strict=True)])
    x = np.where(there, x, mean)
    spread = x.std(axis=0)
    spread = np.where(spread > 1e-12, spread, 1.0)
    z = (x - mean) / spread
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    k = min(int(np.searchsorted(np.cumsum(s**2) / max((s**2).sum(), 1e-300), keep, side="right")) + 1, min(len(x) - 1, x.shape[1]))
    p = z @ vt[:k].T
    a, b = p[: len(xa)], p[len(xa) :]
    within = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / max(len(x) - 2, 1)
    gap = b.mean(0) - a.mean(0)
    way = np.linalg.pinv(within, hermitian=True) @ gap
    return mean, vt[:k].T @ (way / max(np.sqrt(max(way @ gap, 0)), 1e-12)) / spread, k


def test_pair_axes_from_sums():
    rng = np.random.default_rng(2)
    for turn in range(60):
        d = int(rng.integers(2, 7))
        mix = rng.normal(size=(d, d))
        xa, xb = rng.normal(size=(40, d)) @ mix + 100, rng.normal(size=(30, d)) @ mix + 100 + rng.normal(size=d)
        for x in (xa, xb):
            x[rng.random(x.shape) < 0.1] = rng.choice([np.nan, np.inf])
            x[:, 1] = 7.0 if turn % 7 == 0 else x[:, 1]
            x[:, 0] = np.nan if turn % 5 == 0 else x[:, 0]
        other = pairs.Sums.of(rng.normal(size=(9, d)) * 50)
        a = pairs.Sums.of(xa[:10]).plus(pairs.Sums.of(xa[10:])).plus(other)
        a, b = pairs.Sums.unflat(a.plus(other, -1.0).flat()), pairs.Sums.of(xb)
        found = pairs.pair_axis(a, b, floor=1e-9)
        mean, axis, kept = chain(xa, xb)
        assert kept == found.kept
        assert np.allclose(found.mean, mean, atol=1e-7) and np.allclose(found.axis, axis, rtol=1e-5, atol=1e-6), turn


def test_pairwise_out_of_fold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        c = "abc"[i % 3]
        u = rng.normal() + "abc".index(c)
        x = [u, u + 0.01 * rng.normal(), rng.normal() * 3, None if i % 11 == 0 else float(rng.normal() + (c == "b"))]
        rows.append((i, None if i % 50 == 0 else c, i % 4 if c != "c" else 0, *map(lambda v: None if v is None else float(v), x)))
    rows += [(1000, "a", None, 1.0, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id int, label string, fold int, x0 double, x1 double, x2 double, x3 double").repartition(3)
    names = ["x0", "x1", "x2", "x3"]
    found = {(r.id, r.class_a, r.class_b): r for r in pairs.pairwise_out_of_fold(df, "label", names, "id").collect()}
    want = {}
    for fold in {r[2] for r in rows}:
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            train = {c: np.array([[np.nan if v is None else v for v in r[3:]] for r in rows if r[1] == c and r[2] != fold]) for c in (a, b)}
            if not all(len(t) for t in train.values()):
                continue  # fold 0 holds every c
            mean, axis, _ = chain(train[a], train[b])
            for r in rows:
                if r[2] == fold and r[1] in (a, b):
                    x = np.array([np.nan if v is None else v for v in r[3:]])
                    want[r[0], a, b] = float((np.where(np.isfinite(x), x, mean) - mean) @ axis)
    assert set(found) == set(want)
    assert np.allclose([found[k].score for k in want], list(want.values()), rtol=1e-6, atol=1e-8)
    assert {r.kept for r in found.values()} == {3}
    scores = models.pairwise_dprime(pairs.pairwise_out_of_fold(df, "label", names, "id"))
    assert scores.count() == 3 and scores.where("class_a = 'a' and class_b = 'b' and dprime > 0.5").count() == 1
    assert scores.where("dprime is null").count() == 2  # no fold scores c: the one that holds it has nobody to learn from
    assert pairs.pairwise_out_of_fold(df.limit(0), "label", names, "id").count() == 0


def test_merged_scales():
    x = np.random.default_rng(1).normal(size=(50, 3)) + 1e6
    one = lambda z: np.concatenate([[len(z)], z.mean(axis=0), ((z - z.mean(axis=0)) ** 2).sum(axis=0)])
    whole = functools.reduce(P.merged_scales, [one(x[:3]), one(x[3:30]), one(x[30:])])
    assert np.allclose(whole, one(x))


def test_class_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    sizes = [3, 5, 4, 3]
    w, x, y, n = P.start_classes(sizes, 1), rng.normal(size=(20, 3)), rng.integers(0, 3, 20), rng.integers(1, 4, 20).astype(float)
    total = P.class_sums(w, sizes, x, y, n)
    slopes = [(P.class_sums(w + e, sizes, x, y, n)[0] - P.class_sums(w - e, sizes, x, y, n)[0]) / 2e-6 for e in np.eye(len(w)) * 1e-6]
    assert total[1] == n.sum() and np.allclose(total[2:], slopes, atol=1e-5)
    assert np.allclose(total, P.class_sums(w, sizes, np.repeat(x, n.astype(int), axis=0), np.repeat(y, n.astype(int)), np.ones(int(n.sum()))))
    assert np.isfinite(P.class_sums(w * 1e4, sizes, x, y, n)).all()


def test_descent_finds_a_valley():
    def run(rounds):
        g, tried = P.descent(np.array([-1.2, 1.0]), rounds), 0
        at = next(g)
        while True:
            a, b = at
            tried += 1
            try:
                at = g.send((100 * (b - a * a) ** 2 + (1 - a) ** 2, np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])))
            except StopIteration as end:
                return end.value, tried

    assert np.allclose(run(100)[0], 1, atol=0.02) and run(100)[1] < 80
    assert not np.allclose(run(3)[0], 1, atol=0.02)


def test_perceptron_for_classes_learns_equal_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = [(i % 3, float(a), float(b), int(a * b > 0) + int(a + b > 2)) for i, (a, b) in enumerate(rng.uniform(-2, 2, (400, 2)))]
    rows = [(4 * i + j, f, c, a, b) for i, (f, a, b, c) in enumerate(points) for j in range(4)]
    odd = [(9000, 0, None, 1.0, 1.0), (9001, 1, 1, None, 1.0), (9002, 2, 1, float("nan"), 1.0), (9003, 2, 1, 1.0, float("inf"))]
    df = spark.createDataFrame(rows + odd, "id int, fold int, y int, a double, b double").repartition(5)
    seen, fit = [], P.fit_class_folds
    monkeypatch.setattr(P, "fit_class_folds", lambda taught, *rest: seen.append((taught.count(), taught.agg({"n": "sum"}).first()[0])) or fit(taught, *rest))
    found = {r.id: r for r in P.perceptron_out_of_fold(df, "y", ["a", "b"], "id", hidden=(16, 8), rounds=60).collect()}
    assert seen == [(400, 1600.0)] and set(found) == {*range(1600), 9000} and found[9000].truth is None and found[9000].guess in (0, 1, 2)
    assert np.mean([found[i].truth == found[i].guess for i in range(1600)]) > 0.85
    for fold in range(3):
        w, g = None, P.descent(P.start_classes([2, 16, 8, 3], 7), 60)
        train = np.array([p[1:] for p in points if p[0] != fold])
        w = next(g)
        while True:
            total = P.class_sums(w, [2, 16, 8, 3], train[:, :2], train[:, 2].astype(int), np.full(len(train), 4.0))
            try:
                w = g.send((total[0] / total[1], total[2:] / total[1]))
            except StopIteration as end:
                w = end.value
                break
        own = [r for r in rows if r[1] == fold]
        twin = P._activations(P._layers(w, [2, 16, 8, 3]), np.array([r[3:] for r in own]))[-1].argmax(axis=1)
        assert np.mean([found[r[0]].guess == t for r, t in zip(own, twin, strict=True)]) > 0.95
    assert P.perceptron_out_of_fold(df.limit(0), "y", ["a"], "id").count() == 0
    alone = P.perceptron_out_of_fold(df.where("fold = 1"), "y", ["a"], "id", hidden=(4, 3), rounds=2)
    assert alone.count() == 4 * len([p for p in points if p[0] == 1]) and alone.where("guess is not null").count() == 0
