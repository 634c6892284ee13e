"""Separability and distribution statistics, as aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import two_sided_p
from tessera.plans import in_ranges, materialise, totals_before

_TINY = 1e-12


def class_moments(df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, label, n, mean, var): sample variance, 0 for one value; nulls and NaN skipped.

    One pass with an aggregate for each feature; only the class rows are turned into feature rows.
    """
    clean = df.where(F.col(label).isNotNull()).select(*by, F.col(label).alias("label"), *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"__x{i}") for i, f in enumerate(features)])
    sums = [c for i in range(len(features)) for c in (F.count(f"__x{i}").alias(f"n{i}"), F.avg(f"__x{i}").alias(f"m{i}"), F.var_samp(f"__x{i}").alias(f"v{i}"))]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var")) for i, f in enumerate(features)])
    long = clean.groupBy(*by, "label").agg(*sums).select(*by, "label", F.explode(cells).alias("c")).where("c.n > 0")
    return long.select(*by, "c.feature", "label", "c.n", "c.mean", F.when(F.col("c.n") > 1, F.col("c.var")).otherwise(0.0).alias("var"))


def _pairs(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    a = moments.select(*by, "feature", F.col("label").alias("class_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), F.col("var").alias("var_a"))
    b = moments.select(*by, "feature", F.col("label").alias("class_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), F.col("var").alias("var_b"))
    return a.join(b, [*by, "feature"]).where("class_a < class_b")


def dprime_pairs(df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each feature and ordered class pair three effect sizes.

    dprime: |mean difference| over the root of the mean variance, null if that is below
    1e-12; signed_dprime: class b minus class a, 0 if degenerate; cohens_d: by the
    variance pooled over degrees of freedom, null if there are none.
    """
    pooled = F.sqrt(0.5 * (F.col("var_a") + F.col("var_b")))
    free = F.col("n_a") + F.col("n_b") - 2
    joint = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(free, F.lit(0)))
    gap = F.col("mean_b") - F.col("mean_a")
    return _pairs(class_moments(df, label, features, by), by).select(
        *by, "feature", "class_a", "class_b", "n_a", "n_b",
        F.when(pooled >= _TINY, F.abs(gap) / pooled).alias("dprime"),
        F.when(pooled >= _TINY, gap / pooled).otherwise(0.0).alias("signed_dprime"),
        F.when(joint >= _TINY, gap / joint).alias("cohens_d"),
    )


def fisher_ratio(df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Between over within sum of squares of each feature; null if within is below 1e-12. From class moments alone."""
    m = class_moments(df, label, features, by)
    whole = Window.partitionBy(*by, "feature")  # a row for each class
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    sums = m.withColumn("grand", grand).groupBy(*by, "feature").agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"))
    return sums.select(*by, "feature", F.when(F.col("within") >= _TINY, F.col("between") / F.col("within")).alias("fisher"))


def confusion(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, truth, guess, n) for every pair of occurring labels, zeros included."""
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    labels = counts.select(*by, F.explode(F.array("truth", "guess")).alias("truth")).where("truth is not null").distinct()  # a row for each label
    other = labels.withColumnRenamed("truth", "guess")
    grid = labels.join(other, list(by)) if by else labels.join(other, F.lit(True))
    return grid.join(counts, [*by, "truth", "guess"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def recall(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall and row-normalised diagonal of each class; null for a class without rows."""
    return matrix.groupBy(*by, "truth").agg((F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("recall"), F.sum("n").alias("support"))


def accuracy(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the diagonal."""
    return matrix.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))


def error_structure(matrix: DataFrame) -> DataFrame:
    """A10: share of errors between neighbouring integer labels; the most confused ordered pair (smallest of equals)."""
    wrong = matrix.where((F.col("truth") != F.col("guess")) & (F.col("n") > 0))
    near = F.sum(F.when(F.abs(F.col("truth") - F.col("guess")) == 1, F.col("n")).otherwise(0))
    worst = F.max(F.struct(F.col("n"), (-F.col("truth")).alias("t"), (-F.col("guess")).alias("g")))
    return wrong.agg((near / F.nullif(F.sum("n"), F.lit(0))).alias("adjacent_share"), worst.alias("w")).select("adjacent_share", (-F.col("w.t")).alias("worst_truth"), (-F.col("w.g")).alias("worst_guess"), F.col("w.n").alias("worst_n"))


def masked_metrics(df: DataFrame, truth: str, guesses: dict[str, str], masks: dict[str, Column]) -> DataFrame:
    """(mask, model, n, mae, accuracy) for overlapping subsets, from one scan."""
    cells, sums = [], []
    for i, (m, keep) in enumerate(masks.items()):
        for j, (g, c) in enumerate(guesses.items()):
            off = F.when(keep, F.abs(F.col(truth).cast("double") - F.col(c).cast("double")))
            sums += [F.count(off).alias(f"n{i}_{j}"), F.avg(off).alias(f"e{i}_{j}"), F.avg((off == 0).cast("double")).alias(f"a{i}_{j}")]
            cells.append(F.struct(F.lit(m).alias("mask"), F.lit(g).alias("model"), F.col(f"n{i}_{j}").alias("n"), F.col(f"e{i}_{j}").alias("mae"), F.col(f"a{i}_{j}").alias("accuracy")))
    return df.agg(*sums).select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("n > 0")


def majority(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of each group, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max("n").alias("n"))
    met = counts.join(top, [*by, "n"]) if by else counts.join(top, "n")
    return met.groupBy(*by).agg(F.min(value).alias("majority"), F.max("n").alias("n"))


def value_table(df: DataFrame, value: str, is_a: Column, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(by, value, a, b, a_below, b_below, n_a, n_b): counts of two samples at each distinct value, and running counts below it.

    Rows fold into distinct values before anything is sorted; running counts come
    from ranges of (by, value), each sorted on its own, and the totals of the group's ranges before. Ranges follow the number of distinct
    values, so a group has as many as it needs. A null in ``by`` is a group.
    """
    x = F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(x) & is_a.isNotNull()).groupBy(*by, x.alias("value")).agg(F.count(F.when(is_a, 1)).alias("a"), F.count(F.when(~is_a, 1)).alias("b"))
    return running_counts(counts, by, ["value"], ["a", "b"], ranges).select(*by, "value", "a", "b", "a_below", "b_below", "n_a", "n_b")


def running_counts(counts: DataFrame, by: Sequence[str], order: Sequence[str], names: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``counts`` with, for each of ``names``, its total over the group's rows before in ``order`` (x_below) and over all (n_x)."""
    counts = in_ranges(materialise(counts, "values"), [*by, *order], "__bin", ranges=ranges)
    inside = Window.partitionBy(*by, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__{s}1") for s in names])
    placed = totals_before(ranked, by, "__bin", {f"__{s}0": F.sum(s) for s in names})
    whole = counts.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(*[F.sum(s).alias(f"n_{s}") for s in names])
    return placed.join(whole, _same(by)).select(*by, *order, *names, *[(F.col(f"__{s}0") + F.col(f"__{s}1")).alias(f"{s}_below") for s in names], *[f"n_{s}" for s in names])


def _same(by: Sequence[str]) -> Column:
    return reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"__of_{k}")), by, F.lit(True))


def auc(df: DataFrame, score: str, is_positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null without both classes."""
    t = value_table(df, score, is_positive, by)
    wins = F.sum(F.col("a") * (F.col("b_below") + 0.5 * F.col("b")))
    return t.groupBy(*by).agg((wins / F.nullif(F.max("n_a").cast("double") * F.max("n_b"), F.lit(0.0))).alias("auc"), F.max("n_a").alias("n_pos"), F.max("n_b").alias("n_neg"))


def roc_points(df: DataFrame, score: str, is_positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) with everything from the threshold up called positive."""
    t = value_table(df, score, is_positive, by)
    share = lambda s: (F.col(f"n_{s}") - F.col(f"{s}_below")) / F.nullif(F.col(f"n_{s}"), F.lit(0))
    return t.select(*by, F.col("value").alias("threshold"), share("b").alias("fpr"), share("a").alias("tpr"))


def ks_two_sample(df: DataFrame, value: str, is_a: Column, by: Sequence[str] = ()) -> DataFrame:
    """Largest distance between two empirical distributions, and its asymptotic p."""
    t = value_table(df, value, is_a, by)
    share = lambda s: (F.col(f"{s}_below") + F.col(s)) / F.nullif(F.col(f"n_{s}"), F.lit(0))
    found = t.groupBy(*by).agg(F.max(F.abs(share("a") - share("b"))).alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("ks")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * (k * lam) ** 2))
    return found.withColumn("p", F.when(F.col("ks").isNull(), None).when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))


def mann_whitney(df: DataFrame, value: str, is_a: Column, by: Sequence[str] = ()) -> DataFrame:
    """U of sample a, and z and two-sided p by the normal approximation with tie correction and continuity correction."""
    t = value_table(df, value, is_a, by)
    n = F.col("n_a") + F.col("n_b")
    ties = F.col("a") + F.col("b")
    s = t.groupBy(*by).agg(F.sum(F.col("a") * (F.col("b_below") + 0.5 * F.col("b"))).alias("u"), F.sum(ties.cast("double") ** 3 - ties).alias("ties"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    product = F.col("n_a").cast("double") * F.col("n_b")
    sigma = F.sqrt(product / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0))))
    return s.withColumn("z", (F.abs(F.col("u") - product / 2) - 0.5) / F.nullif(sigma, F.lit(0.0))).withColumn("p", two_sided_p(F.col("z"))).drop("ties")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of [low, high], the last one closed on the right; values outside are left out."""
    width = (high - low) / bins
    x = F.col(value).cast("double")
    inside = df.where(x.between(low, high)).withColumn("bin", F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int"))
    return inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def overlap(df: DataFrame, value: str, label: str, bins: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """For each class pair the shared mass of two histograms over the pair's common range; 1 if the range is empty."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & F.col(label).isNotNull()).select(*by, F.col(label).alias("label"), x.alias("x"))
    spans = rows.groupBy(*by, "label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))  # a row for each class
    a = spans.select(*by, F.col("label").alias("class_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("n").alias("n_a"))
    b = spans.select(*by, F.col("label").alias("class_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("n").alias("n_b"))
    pairs = (a.join(b, list(by)) if by else a.join(b, F.lit(True))).where("class_a < class_b")
    pairs = pairs.select(*by, "class_a", "class_b", F.least("lo_a", "lo_b").alias("lo"), F.greatest("hi_a", "hi_b").alias("hi"), "n_a", "n_b")
    ends = pairs.select("*", F.explode(F.array("class_a", "class_b")).alias("label"))
    met = rows.join(ends, [*by, "label"])
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    cells = met.groupBy(*by, "class_a", "class_b", bin_.alias("bin")).agg((F.count(F.when(F.col("label") == F.col("class_a"), 1)) / F.max("n_a")).alias("p"), (F.count(F.when(F.col("label") == F.col("class_b"), 1)) / F.max("n_b")).alias("q"))
    return cells.groupBy(*by, "class_a", "class_b").agg(F.sum(F.least("p", "q")).alias("overlap"))


def position_between(x: Column, low_mean: Column, high_mean: Column) -> Column:
    """0 at the one mean, 1 at the other; null if they are equal."""
    return F.when(F.abs(high_mean - low_mean) > _TINY, (x - low_mean) / (high_mean - low_mean))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 1_000) -> DataFrame:
    """Interpolated quantiles, null and NaN left out; a group without a value has no row (without ``by``: one row of nulls).

    Two passes. The first draws a bracket around each quantile from approximate percentiles, twice as wide as their
    error of n / ``accuracy`` ranks; in a group of less than ten times ``accuracy`` values, where that would be few ranks, all values are in it. The second
    counts values: those in a bracket each, those before a bracket together, as partial aggregates. Only what is left is sorted, in ranges.
    """
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value")).where("value IS NOT NULL")
    ends = [float(e) for q in shares for e in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    cuts = rows.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.count("*").alias("__n"), F.percentile_approx("value", ends, accuracy).alias("__ends"))
    x, low, high = F.col("value"), [F.get("__ends", F.lit(2 * i)) for i in range(len(shares))], [F.get("__ends", F.lit(2 * i + 1)) for i in range(len(shares))]
    inside = reduce(lambda c, i: c | x.between(low[i], high[i]), range(len(shares)), F.col("__n") < 10 * accuracy)
    ahead = F.least(F.lit(float("inf")), *[F.when(c > x, c) for c in low])
    met = rows.join(F.broadcast(cuts) if not by else cuts, _same(by)).select(*by, F.when(inside, x).otherwise(ahead).alias("value"), inside.alias("inside"))  # without ``by`` one row
    t = running_counts(met.groupBy(*by, "value", "inside").agg(F.count("*").alias("a")), by, ["value", "inside"], ["a"])
    place = lambda q: q * (F.col("n_a") - 1)
    at = lambda rank: F.max(F.when(F.col("inside") & (F.col("a_below") <= rank) & (rank < F.col("a_below") + F.col("a")), F.col("value")))
    found = t.groupBy(*by).agg(*[c for i, q in enumerate(shares) for c in (at(F.floor(place(q))).alias(f"__lo{i}"), at(F.ceil(place(q))).alias(f"__hi{i}"), F.max(place(q) - F.floor(place(q))).alias(f"__f{i}"))])
    return found.select(*by, *[(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(f"p{round(q * 100)}") for i, q in enumerate(shares)])


def slope(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope; null for fewer than two points or no spread."""
    return df.groupBy(*by).agg(F.when(F.var_pop(x) > 0, F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))).alias("slope"))


def ellipse(df: DataFrame, x: str, y: str, by: Sequence[str] = (), sigmas: float = 2.0) -> DataFrame:
    """Centre, correlation, half-axes and angle of the covariance ellipse."""
    m = df.groupBy(*by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("sxx"), F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"), F.corr(x, y).alias("r"))
    half, gap = (F.col("sxx") + F.col("syy")) / 2, F.hypot((F.col("sxx") - F.col("syy")) / 2, F.col("sxy"))
    return m.select(*by, "cx", "cy", "r", (sigmas * F.sqrt(half + gap)).alias("major"), (sigmas * F.sqrt(F.greatest(half - gap, F.lit(0.0)))).alias("minor"), F.degrees(0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))).alias("angle"))


def spectrum_shape(df: DataFrame, freq: str, power: str, by: Sequence[str], share: float = 0.85) -> DataFrame:
    """Flatness (geometric over arithmetic mean), centroid, and the least frequency with ``share`` of the power at or below it."""
    f, p = F.col(freq).cast("double"), F.col(power).cast("double")
    base = df.where(p > 0).groupBy(*by).agg((F.exp(F.avg(F.ln(p))) / F.avg(p)).alias("flatness"), (F.sum(f * p) / F.sum(p)).alias("centroid"), F.sum(p).alias("__all"))
    upto = Window.partitionBy(*by).orderBy(freq).rowsBetween(Window.unboundedPreceding, 0)
    rolled = df.where(p > 0).groupBy(*by, freq).agg(F.sum(p).alias("__p")).withColumn("__upto", F.sum("__p").over(upto)).join(base, list(by))
    return rolled.groupBy(*by).agg(F.max("flatness").alias("flatness"), F.max("centroid").alias("centroid"), F.min(F.when(F.col("__upto") >= share * F.col("__all") - 1e-9, F.col(freq))).alias("rolloff"))


def information_transfer(matrix: DataFrame) -> DataFrame:
    """H(truth) + H(guess) - H(truth, guess) of a confusion matrix, in bits."""
    total = matrix.agg(F.sum("n").alias("t"))
    entropy = lambda df: df.join(total, F.lit(True)).where("n > 0").agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("h"))
    parts = [entropy(matrix.groupBy("truth").agg(F.sum("n").alias("n"))), entropy(matrix.groupBy("guess").agg(F.sum("n").alias("n"))), entropy(matrix)]
    named = [p.withColumnRenamed("h", f"h{i}") for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.join(b, F.lit(True)), named).select((F.col("h0") + F.col("h1") - F.col("h2")).alias("bits"))


def groups_by_variety(df: DataFrame, group: str, member: str, mixed: int = 3) -> DataFrame:
    """For each group its number of different members, and whether it is mixed (``mixed`` or more), single (one) or neither."""
    found = df.groupBy(group).agg(F.count_distinct(member).alias("members"), F.count("*").alias("n"))
    return found.withColumn("kind", F.when(F.col("members") >= mixed, "mixed").when(F.col("members") == 1, "single").otherwise("few"))


def median_stack(df: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """The median of each cell (a pixel) over a stack of frames."""
    return df.groupBy(*cell).agg(F.median(value).alias("median"), F.count(value).alias("n"))
