"""Joins, sequences, folds and models against small brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.values import two_sided_p
from tessera.operators import audit, encode, folds, joins, models, retrieve, sequence, stats
from tessera.plans import connected_components, materialise, running_total, settled, workspace
from tessera.queries import QUERIES


def test_duplicate_keys_fail(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, 2.0)], "k int, f double")
    with pytest.raises(joins.DuplicateKeys):
        joins.one_to_one(a, b, ["k"])
    with pytest.raises(joins.DuplicateKeys):
        joins.fuse_left(b, (a, ["v"]), key="k")
    assert joins.fuse_left(a, (b, ["f"]), key="k").count() == 2


def test_asof_carries_over_buckets(spark):
    left = spark.createDataFrame([("a", float(t)) for t in (0, 5, 50, 500)] + [("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 3.0, 1), ("a", 40.0, 2), ("a", 40.0, 3)], "k string, t double, v int")
    got = {(r.k, r.t): r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"], 10.0, False).collect()}
    assert got == {("a", 0.0): None, ("a", 5.0): 1, ("a", 50.0): 3, ("a", 500.0): 3, ("b", 1.0): None}
    got = {(r.k, r.t): r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"], 10.0).collect()}
    assert got["a", 0.0] == 1 and got["b", 1.0] is None


def test_window_join_ties_and_misses(spark):
    cues = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 9.0), ("q", 3, -0.1)], "run string, cue_id int, cue double")
    peaks = spark.createDataFrame([("r", 0.9, 5.0), ("r", 1.2, 5.0), ("r", 1.3, 1.0)], "run string, peak double, strength double")
    got = {r.cue_id: (r.onset, r.found) for r in joins.strongest_in_window(cues, peaks, ["run"], 0.15, 0.45).collect()}
    assert got == {1: (0.9, True), 2: (9.0, False), 3: (0.0, False)}


def test_zip_and_ordinals(spark):
    rows = [(i, (i * 7) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, x int")
    got = {r.k: r.ordinal for r in joins.sorted_ordinal(df, F.col("x"), [F.col("k")], bins=8).collect()}
    assert got == {k: x for k, x in rows}
    assert joins.zipped(df, df, [F.col("k")], [F.col("k")], "k").where("not agrees").count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_counts_in_ranges_cut_by_group(spark, ranges):
    """A wide group, a narrow one inside its span, a null one and ties, in one range or in more than a group holds."""
    rng = np.random.default_rng(3)
    rows = [("wide", float(v), bool(v % 3)) for v in rng.integers(-1000, 1000, 400)] + [("narrow", 5 + v / 1000, bool(v % 2)) for v in range(60)] + [(None, 1.0, True), (None, 1.0, False), (None, None, True), (None, float("nan"), True), ("wide", 0.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, a boolean")
    out = stats.value_table(df, "v", F.col("a"), ["g"], ranges).collect()
    clean = [r for r in rows if r[1] is not None and r[1] == r[1] and r[2] is not None]
    assert {(r.g, r.value) for r in out} == {r[:2] for r in clean} and len(out) == len({r[:2] for r in clean})
    for r in out:
        own = [x for x in clean if x[0] == r.g]
        count = lambda a, keep: sum(x[2] == a and keep(x[1]) for x in own)
        want = [count(a, keep) for keep in (lambda v: v == r.value, lambda v: v < r.value, lambda v: True) for a in (True, False)]
        assert [r.a, r.b, r.a_below, r.b_below, r.n_a, r.n_b] == want
    assert stats.value_table(df.limit(0), "v", F.col("a"), ["g"]).count() == 0


def test_running_total_hot_and_null_keys(spark):
    rows = [(None if i % 3 else "hot", i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    out = running_total(df, ["g"], F.xxhash64("i"), ["i"], F.col("v"), "before", bins=8).collect()
    for g in (None, "hot"):
        own = [r for r in out if r.g == g]
        spans = sorted((r.before, r.before + r.v) for r in own)
        assert sum(r.v for r in own) == spans[-1][1] and all(a[1] <= b[0] or a == b for a, b in zip(spans, spans[1:]))
    assert running_total(df.limit(0), ["g"], F.xxhash64("i"), ["i"], F.col("v"), "before").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (5, 5)] + [(None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and got[7] == got[9] == 3 and got[5] == 5 and 1 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sequences(spark):
    ts = F.array(*[F.lit(x) for x in (0.5, 0.0, 0.05, 0.07, 0.13)])
    peaks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("strength")) for t, s in ((0.0, 1.0), (0.3, 3.0), (0.9, 2.0), (2.0, 0.5))])
    widths = F.array(*[F.lit(x).cast("double") for x in (None, 9, 1, 1, None, 1.2, 9, 9, 9, 9, 1)])
    r = spark.range(1).select(
        sequence.min_gap(ts, 0.06), sequence.top_spaced(peaks, 0.5), sequence.top_spaced(peaks, 0.5, F.lit(1)), sequence.with_head(F.array(F.lit(0.2)), F.lit(1.0), F.lit(1.0)), sequence.with_head(F.array(F.lit(0.01)), F.lit(1.0), F.lit(1.0)),
        sequence.bridged_run(widths, 2.0), sequence.bridged_run(F.array(F.lit(9.0)), 2.0), sequence.rounded_peaks(F.array(F.lit(1.04), F.lit(1.01), F.lit(0.5)), 1),
    ).first()
    assert r[0] == [0.0, 0.07, 0.13, 0.5] and r[1] == [0.3, 0.9, 2.0] and r[2] == [0.3] and r[3] == [0.0, 0.2] and r[4] == [0.01] and tuple(r[5]) == (2, 5) and r[6] is None and r[7] == [0.5, 1.0]


def test_backtrack(spark):
    energy = spark.createDataFrame([("r", float(i), e) for i, e in enumerate((5, 1, 3, 9, 2, 8))], "run string, t double, energy int")
    peaks = spark.createDataFrame([("r", 3.0), ("r", 5.0), ("r", 0.5)], "run string, t double")
    assert {r.t: r.onset for r in sequence.backtracked(peaks, energy, ["run"]).collect()} == {3.0: 1.0, 5.0: 4.0, 0.5: 0.5}


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("c", float("nan"))], "y string, x double")
    r = stats.dprime_pairs(df, "y", ["x"]).collect()
    assert len(r) == 1 and r[0].dprime is None and r[0].signed_dprime == 0 and r[0].cohens_d is None
    assert stats.fisher_ratio(df, "y", ["x"]).first().fisher is None
    assert stats.auc(df.limit(0), "x", F.col("y") == "a").first().auc is None
    assert stats.overlap(df.where("y <> 'c'"), "x", "y").first().overlap == 1


def test_ks_p_is_small_for_shifted_samples(spark):
    rng = np.random.default_rng(0)
    rows = [(0, float(x)) for x in rng.normal(size=300)] + [(1, float(x)) for x in rng.normal(1, 1, 300)]
    r = stats.ks_two_sample(spark.createDataFrame(rows, "s int, x double"), "x", F.col("s") == 0).first()
    assert r.ks > 0.3 and r.p < 1e-6


def test_group_folds_are_balanced_and_whole(spark):
    df = spark.createDataFrame([(g, i) for g, n in enumerate((9, 5, 5, 3, 1, 1)) for i in range(n)], "g int, i int")
    out = folds.grouped(df, "g", 3)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("f")).where("f > 1").count() == 0
    assert sorted(r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [7, 8, 9]
    with pytest.raises(ValueError):
        folds.leave_one_out(df.where("g = 1"), "g")


def test_training_statistics_ignore_the_held_out_fold(spark):
    rows = [(i, i % 3, float(i)) for i in range(30)]
    clean = spark.createDataFrame(rows, "id int, fold int, x double")
    spoiled = spark.createDataFrame([(i, f, 1e9 if f == 0 else x) for i, f, x in rows], "id int, fold int, x double")
    pick = lambda df: folds.train_statistics(df, ["x"]).where("fold = 0").first()
    assert pick(clean).mean == pytest.approx(pick(spoiled).mean) and pick(clean).n == 20
    assert pick(clean).mean == pytest.approx(np.mean([x for _, f, x in rows if f]))


def blobs(spark, n=150):
    rng = np.random.default_rng(3)
    rows = [(i, c, i % 5, *map(float, rng.normal(0, 1, 3) + (3 * c, -2 * c, 0))) for i, c in enumerate(rng.integers(0, 3, n).tolist())]
    return rows, spark.createDataFrame(rows, "id int, y int, fold int, a double, b double, c double")


def test_pca_and_lda(spark):
    rows, df = blobs(spark)
    x = np.array([r[3:] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T, ddof=0))[::-1]
    p = models.pca(df, ["a", "b", "c"], 3)
    assert p.share == pytest.approx(values / values.sum())
    scores = np.array([list(r) for r in df.select(*p.columns("pc")).collect()])
    assert scores.var(axis=0) == pytest.approx(values)
    found = models.lda_out_of_fold(df, "y", ["a", "b", "c"], "id").collect()
    assert np.mean([r.truth == r.guess for r in found]) > 0.85
    assert [f for f, a, _ in p.loadings() if a == 1][0] in ("a", "b")


def test_fold_moments_equal_a_fit_without_the_fold(spark):
    _, df = blobs(spark)
    whole, own = models.gather_moments(df, "y", ["a", "b"]), models.gather_moments(df.where("fold = 1"), "y", ["a", "b"])
    rest, direct = models.less(whole, own), models.gather_moments(df.where("fold <> 1"), "y", ["a", "b"])
    assert rest.n == pytest.approx(direct.n) and rest.mean == pytest.approx(direct.mean) and rest.scatter == pytest.approx(direct.scatter)


def test_shrinkage_and_bimodality(spark):
    _, df = blobs(spark)
    _, cov, share = models.shrunk_covariance(df, ["a", "b", "c"])
    assert 0 <= share <= 1 and np.all(np.linalg.eigvalsh(cov) > 0)
    rng = np.random.default_rng(1)
    two = [(float(x),) for x in np.concatenate([rng.normal(0, 1, 200), rng.normal(8, 1, 200)])]
    assert models.bimodality(spark.createDataFrame(two, "x double"), "x")["bimodal"]
    assert not models.bimodality(spark.createDataFrame([(float(x),) for x in rng.normal(0, 1, 300)], "x double"), "x")["bimodal"]


def test_nearest_neighbours_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in retrieve.nearest(df, df, 3, block=16).collect():
        got.setdefault(r.query, {})[r.rank] = r.vec_id
    assert all([got[i][k] for k in (1, 2, 3)] == np.argsort(-s[i])[:3].tolist() for i in range(60))
    assert retrieve.seeded_search(df, F.col("vec_id") < 0, 5, 3).count() == 0


def test_neighbours_are_sent_a_bounded_number_of_times(spark):
    """Vectors in all directions: four times the rows shuffle about four times as much; a vector that is not finite hides none in its cell."""
    rng = np.random.default_rng(7)
    store, sent = spark.sparkContext._jsc.sc().statusStore(), []
    total = lambda: store.executorList(False).head().totalShuffleWrite()
    for n in (500, 2000):
        x = rng.normal(size=(n, 16))
        odd = [(n, [float("nan")] * 16), (n + 1, [float("inf")] * 16)]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id bigint, embedding array<double>")
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        before = total()
        found = {(r.query, r["rank"]): r.vec_id for r in retrieve.nearest(df, df, 3, block=16).collect()}
        sent.append(total() - before)
        best = np.argsort(-s, axis=1)[:, :3]
        assert found == {(i, j + 1): int(best[i, j]) for i in range(n) for j in range(3)}
    assert sent[1] < 6 * sent[0]


@pytest.mark.parametrize("block", [2048, 8])
def test_neighbours_by_pivots_lose_none(spark, block):
    """Tight clusters, among which most cells are out of reach, equal vectors, zero ones, and fewer rows than asked for."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(12, 6)), 12, axis=0) + rng.normal(0, 0.05, (144, 6))
    x[10:14] = x[9]
    x[20:23] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id bigint, embedding array<double>")
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(length == 0, 1, length)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in retrieve.nearest(df, df, 5, block=block).collect():
        got.setdefault(r.query, {})[r.rank] = r.score
        assert abs(r.score - s[r.query, r.vec_id]) < 1e-9
    assert set(got) == set(range(144))
    assert all(np.allclose([got[i][k] for k in range(1, 6)], -np.sort(-s[i])[:5], atol=1e-9) for i in got)
    assert retrieve.nearest(df.where("vec_id < 3"), df.where("vec_id < 3"), 5).count() == 6
    zero = df.where("vec_id between 20 and 22")
    assert [r.vec_id for r in retrieve.nearest(zero.where("vec_id = 21"), zero, 5).orderBy("rank").collect()] == [20, 22]
    assert retrieve.nearest(df, df.limit(0), 5).count() == retrieve.nearest(df.limit(0), df, 5).count() == 0
    centres, all_ = u[[0, 30, 60]], u[u.any(axis=1)]
    cell, angle = retrieve._cells(all_, centres)
    radii = np.array([angle[cell == c].max() for c in range(3)])
    bound = retrieve._bounds(all_, centres, radii)
    assert all(bound[i, cell[j]] >= all_[i] @ all_[j] - 1e-9 for i in range(len(all_)) for j in range(len(all_))) and (bound < 0.9).any()


def test_silhouette_needs_two_labels(spark):
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(5)], "vec_id bigint, label int, embedding array<double>")
    assert retrieve.silhouette(df, "label").first().silhouette is None


def test_chords_keep_the_last_string_of_a_finger(spark):
    df = spark.createDataFrame([("c", [1, 3, 0, -1, 1, 2], [1, 2, 0, 0, 1, 9])], "name string, shape array<int>, fingers array<int>")
    got = sorted((r.finger, r.string, r.fret) for r in encode.fingers_of(df, F.col("shape"), F.col("fingers")).collect())
    assert got == [(1, 2, 1), (2, 5, 3)]
    assert df.select(encode.corrected_chord(F.lit("G"), F.col("shape"), {"G": [3, 2, 0, 0, 0, 3]})).first()[0] == [3, 2, 0, 0, 0, 3]


def test_plans(spark):
    plan = encode.plan_runs(spark.range(1, 3).withColumnRenamed("id", "pass"), [6, 5], ["a", "b", "c"], 1)
    assert plan.count() == 12 and plan.groupBy("pass", "string").agg(F.sum("turn").alias("s")).where("s <> 6").count() == 0
    steps = spark.createDataFrame([("k", 5, "y"), ("k", 2, "x"), ("l", 1, None)], "chart string, i int, name string")
    chart = [(r.chart, r.pos, r.name, r.t) for r in encode.chart_of_sequence(steps, ["chart"], "i", "name", 2, 120.0).orderBy("chart", "pos").collect()]
    assert chart == [("k", 0, "x", 0.0), ("k", 1, "y", 0.5), ("k", 2, "x", 1.0), ("k", 3, "y", 1.5), ("l", 0, None, 0.0), ("l", 1, None, 0.5)]
    assert encode.chart_of_sequence(steps, ["chart"], "i", "name", 0, 120.0).count() == 0


def test_two_adapters_of_each_host(spark):
    rows = spark.createDataFrame([("a", 7), ("a", 3), ("a", 9), ("b", 4), (None, 1)], "host string, i int")
    found = {r.host: (r.first, r.second) for r in joins.two_adapters(rows, "i", host=["host"]).collect()}
    assert found == {"a": (3, 7), "b": (4, None), None: (1, None)}
    assert tuple(joins.two_adapters(rows, "i").first()) == (1, 3) and tuple(joins.two_adapters(rows.limit(0), "i").first()) == (None, None)
    assert tuple(joins.two_adapters(rows, "i", (9, 4)).first()) == (4, 9)


def test_advice_falls_back(spark):
    facts = spark.createDataFrame([(1,)], "x int")
    rules = [(2, "b", F.col("x") > 0), (1, "a", F.col("x") > 0), (3, "c", F.col("x") > 5)]
    assert [r.advice for r in audit.recommendations(facts, rules, "fine").orderBy("priority").collect()] == ["a", "b"]
    assert [r.advice for r in audit.recommendations(facts, rules[2:], "fine").collect()] == ["fine"]


def test_settled_keeps_the_result_and_drops_the_rest(spark):
    before = set(workspace._WRITTEN)
    out = settled(spark, lambda: materialise(spark.range(5), "a").where("id > 1"), "b")
    assert sorted(r.id for r in out.collect()) == [2, 3, 4] and len(set(workspace._WRITTEN) - before) == 1


def test_notes_of_whole_turns(spark, tmp_path):
    """unnest_notes reads every word of a turn, not only its first six; empty words and a null text give nothing."""
    text = " ".join(["abcdefghi"] * 6 + ["ab", "", "abc", "abc", "a" * 10])
    rows = [("c", 0, text), ("c", 1, None), ("c", 2, "ab")]
    spark.createDataFrame(rows, "conv_id string, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.event, r.string, r.fret, r.n) for r in QUERIES["unnest_notes"](spark, str(tmp_path)).collect())
    assert got == [(0, 2, 1, 1), (0, 3, 2, 2), (1, 2, 1, 1)]


def test_two_sided_p(spark):
    import math

    zs = [-3.0, 0.0, 0.3, 1.0, 1.96, 2.8, 2.9, 5.0, 12.0, 30.0, 300.0, None]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z")).alias("p")).collect()]
    assert got.pop() is None and got[0] == 1
    for z, p in zip(zs[1:], got[1:], strict=False):
        assert p == pytest.approx(math.erfc(z / 2**0.5), rel=1e-9, abs=1e-300)


def test_pairwise_axes_learn_from_other_folds_only(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3], i // 3 % 4, *map(float, rng.normal(i % 3, 1, 2))) for i in range(120)]
    rows += [(200, "d", 0, 1.0, 2.0), (201, "a", 1, None, 2.0)]  # d is in fold 0 alone: no axis is left for it there
    got = models.pairwise_out_of_fold(spark.createDataFrame(rows, "id int, c string, fold int, x double, y double"), "c", ["x", "y"], "id").collect()
    assert not [r for r in got if r.id in (200, 201)]
    for fold, a, b in [(0, "a", "b"), (3, "b", "c")]:
        part = {k: np.array([r[3:] for r in rows[:120] if r[1] == k and r[2] != fold]) for k in (a, b)}
        within = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in part.values()) / (sum(map(len, part.values())) - 2)
        axis = np.linalg.solve(within, part[b].mean(0) - part[a].mean(0))
        axis /= np.sqrt(axis @ within @ axis)
        want = {r[0]: (np.array(r[3:]) - np.concatenate(list(part.values())).mean(0)) @ axis for r in rows[:120] if r[2] == fold and r[1] in (a, b)}
        found = {r.id: r.score for r in got if (r.fold, r.class_a, r.class_b) == (fold, a, b)}
        assert found == pytest.approx(want)


def test_third_axis_is_wide_and_unused():
    assert models.third_axis(np.array([[3.0, 0.0], [0.1, 0.0], [0.0, 0.0]])) == 1
    assert models.third_axis(np.array([[0.0, 0.0], [2.0, 2.0]])) == 0


def test_quantiles_of_groups(spark):
    rows = [("a", v) for v in (4.0, 1.0, 1.0, None, float("nan"), 10.0)] + [("b", None), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p25, r.p50) for r in stats.quantiles(df, "v", [0.25, 0.5], ["g"]).collect()}
    assert got == {"a": (1.0, 2.5), "c": (2.0, 2.0)}
    assert stats.quantiles(df.where("g = 'b'"), "v", [0.5]).first().p50 is None


def test_quantiles_from_brackets(spark):
    """Groups large enough for brackets (100 values at this accuracy), with ties and a constant one, next to a small one."""
    rng = np.random.default_rng(9)
    groups = {"wide": rng.normal(size=3000), "ties": rng.integers(0, 12, 1500).astype(float), "same": np.full(400, 7.0), "few": rng.normal(size=9), None: np.arange(500.0)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for r in stats.quantiles(df, "v", shares, ["g"], accuracy=10).collect() + stats.quantiles(df, "v", shares, ["g"], accuracy=50).collect():
        assert np.allclose([r[f"p{round(q * 100)}"] for q in shares], np.quantile(groups[r.g], shares)), r
    one = stats.quantiles(df.where("g = 'wide'"), "v", shares, accuracy=100).first()
    assert np.allclose([one[f"p{round(q * 100)}"] for q in shares], np.quantile(groups["wide"], shares))
