"""Folds, and statistics that see the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """V1: ``fold``: rank from 0 of the row's group among the sorted groups; fails with fewer than two groups."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    ranked = groups.withColumn("fold", F.row_number().over(Window.orderBy(group)) - 1)  # a row for each group
    if ranked.where("fold = 1").isEmpty():
        raise ValueError(f"leaving one {group} out needs two at least")
    return df.join(ranked, group)


def stratified(df: DataFrame, label: str, key: str, most: int = 5, k: int | None = None) -> DataFrame:
    """V2, V4: ``fold`` of 0..k-1, even in every class: k = smallest class within [2, ``most``], rows of a class dealt by ascending key.

    Ranks in a class come from ranges of (class, key), so a class is not sorted in one task.
    """
    from tessera.plans import in_ranges, totals_before

    if k is None:
        least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
        k = max(2, min(most, least))
    tagged = in_ranges(df, [label, key], "__bin")
    rank = F.row_number().over(Window.partitionBy(label, "__bin").orderBy(key))
    ranked = totals_before(tagged.withColumn("__rank", rank), [label], "__bin", {"__start": F.count("*")})
    return ranked.withColumn("fold", F.pmod(F.col("__start") + F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__bin", "__rank", "__start")


def grouped(df: DataFrame, group: str, k: int) -> DataFrame:
    """V3: ``fold`` of 0..k-1, whole groups in one fold, each group, the largest first, into the lightest fold.

    Groups of one size are alike, so it is enough to know how many of them each fold takes: folds below
    the level that m groups of size n reach are filled up to it, the rest goes round in order of load.
    Only the sizes are folded in order (there are few: n different ones
    need n * n / 2 rows), and a group's place among those of its size is a running total.
    """
    from tessera.plans import running_total

    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    listed = sizes.groupBy("__n").agg(F.count("*").alias("m")).agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("neg"), "m"))).alias("sizes"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.array_repeat(zero, k).alias("load"), F.array().cast("array<struct<n:bigint,takes:array<bigint>>>").alias("out"))
    total = lambda xs: F.aggregate(xs, zero, lambda t, x: t + x)

    def deal(s: Column, c: Column) -> Column:
        n, m, load = -c["neg"], c["m"], s["load"]
        upto = lambda level: F.transform(load, lambda x: F.greatest(F.ceil((level - x) / n), zero))
        level = F.array_max(F.filter(load, lambda x: total(upto(x)) <= m))
        filled = F.zip_with(load, upto(level), lambda x, t: F.struct((x <= level).alias("open"), (x + n * t).alias("load"), t.alias("t")))
        turns = F.filter(F.transform(filled, lambda f, i: F.struct(f["open"].alias("open"), f["load"].alias("load"), i.alias("i"))), lambda f: f["open"])
        rest = m - total(F.transform(filled, lambda f: f["t"]))
        place = lambda i: F.array_position(F.transform(F.array_sort(turns), lambda f: f["i"]), i)
        more = lambda f, i: F.when(f["open"], F.floor(rest / F.size(turns)) + (place(i) <= rest % F.size(turns)).cast("bigint")).otherwise(zero)
        takes = F.transform(filled, lambda f, i: f["t"] + more(f, i))
        return F.struct(F.zip_with(load, takes, lambda x, t: x + n * t).alias("load"), F.concat(s["out"], F.array(F.struct(n.alias("n"), takes.alias("takes")))).alias("out"))

    plan = listed.select(F.explode(F.aggregate("sizes", start, deal)["out"]).alias("c"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: total(F.slice("c.takes", F.lit(1), i)))
    plan = plan.select(F.col("c.n").alias("__of"), ends.alias("ends"))
    ranked = running_total(sizes, ["__n"], F.xxhash64(F.col(group)), [group], F.lit(1), "__rank", 64)
    folds = ranked.join(plan, F.col("__n") == F.col("__of")).select(group, F.size(F.filter("ends", lambda e: e <= F.col("__rank"))).cast("int").alias("fold"))
    return df.join(folds, group)


def train_statistics(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """V5: (fold, by, feature, n, mean, sd) over the rows *outside* each fold: totals less the fold's own sums.

    One aggregate by fold; no row is repeated for the folds it trains. Missing values are left out; the standard deviation
    is the population's, 1 where it is 0; a feature without a training value has mean 0 (§1.5).
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("x")) for f in features])
    long = df.select("fold", *by, F.explode(cells).alias("c")).select("fold", *by, "c.feature", "c.x")
    own = long.groupBy("fold", *by, "feature").agg(F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("q"))
    whole = own.groupBy(*by, "feature").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    folds = df.select("fold").distinct()
    every = folds.join(whole, F.lit(True))  # folds x features rows
    met = every.join(own, ["fold", *by, "feature"], "left")
    n, s, q = (F.col(t) - F.coalesce(F.col(o), F.lit(0)) for t, o in (("all_n", "n"), ("all_s", "s"), ("all_q", "q")))
    mean = F.when(n > 0, s / n).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.when(n > 0, q / n).otherwise(0.0) - mean * mean, F.lit(0.0)))
    return met.select("fold", *by, "feature", n.alias("n"), mean.alias("mean"), F.when(spread > 1e-12, spread).otherwise(1.0).alias("sd"))


def standardised(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """M1, V5: (key, fold, feature, z): every value imputed with its fold's training mean and scaled by its training spread."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("x")) for f in features])
    long = df.select(key, "fold", F.explode(cells).alias("c")).select(key, "fold", "c.feature", "c.x")
    return long.join(train_statistics(df, features), ["fold", "feature"]).select(key, "fold", "feature", ((F.coalesce("x", "mean") - F.col("mean")) / F.col("sd")).alias("z"))


def zscore(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """M1: population z-scores over all rows, spread 0 counting as 1; null stays null."""
    stats = df.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    met = df.join(stats, F.lit(True))  # one row
    return met.withColumns({f"z_{f}": (F.col(f) - F.col(f"__m_{f}")) / F.when(F.col(f"__s_{f}") > 0, F.col(f"__s_{f}")).otherwise(1.0) for f in features}).drop(*stats.columns)


def nearest_mean(df: DataFrame, label: str, vector: str, key: str) -> DataFrame:
    """Out-of-fold prediction by the nearest class mean (Euclidean): (key, fold, truth, guess, distance).

    ``vector`` is an array of numbers. Class sums are taken by (fold, class) at each place and
    subtracted from the totals. The means of a fold are gathered in one array, as wide as
    classes x dimensions; the nearest one is found in the row. Equal distances: the smaller label.
    """
    long = df.select("fold", F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    own = long.groupBy("fold", "label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n"))
    whole = own.groupBy("label", "i").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    folds = df.select("fold").distinct()
    met = folds.join(whole, F.lit(True)).join(own, ["fold", "label", "i"], "left")
    means = met.select("fold", "label", "i", ((F.col("all_s") - F.coalesce("s", F.lit(0.0))) / F.nullif(F.col("all_n") - F.coalesce("n", F.lit(0)), F.lit(0))).alias("m")).where("m is not null")
    vectors = means.groupBy("fold", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))
    model = vectors.groupBy("fold").agg(F.collect_list(F.struct("label", "mean")).alias("means"))
    far = lambda m: F.aggregate(F.zip_with(vector, m, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("means", lambda c: F.struct(far(c["mean"]).alias("d"), c["label"].alias("label"))))
    return df.join(model, "fold").withColumn("__best", best).select(key, "fold", F.col(label).alias("truth"), F.col("__best.label").alias("guess"), F.sqrt("__best.d").alias("distance"))
