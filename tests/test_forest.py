"""Forests on counts against Spark's forests on rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import forest, models


def parts(spark, n=1500):
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 31, n), rng.uniform(0, 1, n).round(2)
    y = np.where(rng.random(n) < 0.05, rng.integers(0, 3, n), np.minimum(a // 8, 2))
    return spark.createDataFrame([(i, i % 3, int(y[i]), float(a[i]), float(b[i]), float(a[i] + 10 * (a[i] > 20))) for i in range(n)], "id int, fold int, y int, a double, b double, v double")


@pytest.mark.parametrize("classes", [True, False])
def test_forest_on_counts_follows_forest_on_rows(spark, classes, monkeypatch):
    df, label = parts(spark), "y" if classes else "v"
    kind = dict(featuresCol="features", labelCol=label, numTrees=40, maxDepth=12, maxBins=16, minInstancesPerNode=2, seed=7)
    learner = RandomForestClassifier(weightCol="__w", **kind) if classes else RandomForestRegressor(**kind)
    rows = {r.id: r.guess for r in models.out_of_fold(df, label, ["a", "b"], "id", learner).collect()}
    monkeypatch.setattr(models, "out_of_fold", None)  # no learner whose work grows with the rows
    run = models.forest_out_of_fold if classes else models.forest_values_out_of_fold
    found = run(df, label, ["a", "b"], "id", trees=40, depth=12, bins=16)
    assert found.columns == ["id", "fold", "truth", "guess"] and dict(found.dtypes)["guess"] == ("int" if classes else "double")
    own = {r.id: (r.truth, r.guess) for r in found.collect()}
    assert set(own) == set(rows)
    if classes:
        assert np.mean([own[i][1] == rows[i] for i in rows]) > 0.96
    else:
        off, twin = (np.mean([(g - own[i][0]) ** 2 for i, g in guess.items()]) for guess in ({i: v[1] for i, v in own.items()}, rows))
        assert off < 1.3 * twin and np.mean([(own[i][1] - rows[i]) ** 2 for i in rows]) < 0.05 * np.var([v[0] for v in own.values()])
    again = {r.id: (r.truth, r.guess) for r in run(df.repartition(5), label, ["a", "b"], "id", trees=40, depth=12, bins=16).collect()}
    assert again == own


def test_odd_rows_and_many_cells(spark, monkeypatch):
    df = parts(spark, 300)
    odd = spark.createDataFrame([(900, 0, None, 1.0, 0.5, None), (901, 1, 1, None, 0.5, 1.0), (902, 2, 1, float("nan"), 0.5, 1.0)], df.schema)
    found = models.forest_out_of_fold(df.unionByName(odd), "y", ["a", "b"], "id", trees=5, depth=6, bins=8)
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {*range(300), 900} and rows[900].truth is None and all(r.guess is not None for r in rows.values())
    alone = models.forest_out_of_fold(df.where("fold = 1"), "y", ["a"], "id", trees=3, depth=3)
    assert alone.count() == 100 and alone.where("guess is not null").count() == 0
    assert models.forest_out_of_fold(df.limit(0), "y", ["a"], "id", trees=3).count() == 0
    monkeypatch.setattr(forest, "CELLS", 10)
    whole = models.forest_out_of_fold(df, "y", ["a", "b"], "id", trees=3, depth=3)
    assert whole.count() == 300 and dict(whole.dtypes)["guess"] == "int"


def test_best_splits_against_all_splits():
    rng = np.random.default_rng(2)
    bins, y = rng.integers(0, 6, (200, 3)), rng.integers(0, 3, 200)
    stats, law = np.eye(3)[y] * rng.integers(1, 4, 200)[:, None], forest.Law(8, 2, 3, np.array([1.0, 0.5, 2.0]))
    tree = forest.grow(bins, stats, [6, 6, 6], law, rng)

    def gini(w):
        return 1 - ((w / w.sum()) ** 2).sum() if w.sum() else 0.0

    at, inner = {0: np.arange(200)}, 0
    for k, left in enumerate(tree.left):
        own = at[k]
        assert np.array_equal(stats[own].sum(axis=0), tree.total[k])
        gains = {}
        for f in range(3):
            for cut in range(5):
                low = bins[own, f] <= cut
                a, b = stats[own][low].sum(axis=0), stats[own][~low].sum(axis=0)
                if min(a.sum(), b.sum()) >= 2:
                    wa, wb = a * law.weight, b * law.weight
                    gains[f, cut] = gini(wa + wb) - (wa.sum() * gini(wa) + wb.sum() * gini(wb)) / (wa + wb).sum()
        if left >= 0:
            inner += 1
            assert abs(gains[tree.feature[k], tree.cut[k]] - max(gains.values())) < 1e-12
            low = bins[own, tree.feature[k]] <= tree.cut[k]
            at[left], at[left + 1] = own[low], own[~low]
    assert inner > 10
    shares = forest.votes(tree, bins, law)
    assert np.allclose(shares.sum(axis=1), 1) and (shares.argmax(axis=1) == forest.votes(forest.pruned(tree, law), bins, law).argmax(axis=1)).mean() > 0.99
