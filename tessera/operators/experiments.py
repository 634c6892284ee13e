"""Experiments built from the statistics, folds and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds, models, stats


def holdout(df: DataFrame, label: str, key: str, parts: int = 5) -> DataFrame:
    """V4: ``held_out`` for one of ``parts`` equal parts of every class."""
    return folds.stratified(df, label, key, k=parts).withColumn("held_out", F.col("fold") == 0).drop("fold")


def leakage_gap(df: DataFrame, label: str, features: Sequence[str], key: str, group: str, k: int = 5, most: float = 0.07) -> DataFrame:
    """Out-of-fold accuracy with random and with whole-group folds, their gap, and whether it tells of leakage."""
    parts = []
    for name, folded in (("random", folds.stratified(df, label, key, k=k)), ("grouped", folds.grouped(df, group, k))):
        found = models.lda_out_of_fold(folded, label, features, key)
        parts.append(found.agg(F.avg((F.col("truth") == F.col("guess")).cast("double")).alias(name)))
    return parts[0].join(parts[1], F.lit(True)).withColumn("gap", F.col("random") - F.col("grouped")).withColumn("leaks", F.col("gap") > most)


def ablation(df: DataFrame, label: str, sets: dict[str, Sequence[str]], key: str) -> DataFrame:
    """(arm, n, accuracy) of the same folds on several feature sets and on the majority class.

    Every arm sees the rows on which all sets are complete, so arms differ in features alone.
    """
    every = sorted({f for fs in sets.values() for f in fs})
    rows = df.dropna(subset=every)
    out = stats.majority(rows, label).join(rows.agg(F.count("*").alias("all")), F.lit(True)).select(F.lit("majority").alias("arm"), F.col("all").alias("n"), (F.col("n") / F.col("all")).alias("accuracy"))  # one row each
    for name, features in sets.items():
        found = models.lda_out_of_fold(rows, label, features, key)
        out = out.unionByName(found.agg(F.lit(name).alias("arm"), F.count("*").alias("n"), F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("accuracy")))
    return out


def transfer(train: DataFrame, other: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Rows of ``other`` on the axis learned from two classes of ``train``: position from one class mean (0) to the other (1)."""
    found = models.lda(models.gather_moments(train, label, features), features)
    means = train.select(label, *found.axes.columns("axis")).groupBy(label).agg(F.avg("axis1").alias("m")).orderBy(label)
    low, high = [r.m for r in means.collect()][:2]  # two classes
    scored = other.select("*", *found.axes.columns("axis"))
    return scored.withColumn("position", stats.position_between(F.col("axis1"), F.lit(low), F.lit(high))).drop("axis1")


def off_detection(df: DataFrame, label: str, features: Sequence[str], key: str, seed: int = 7) -> DataFrame:
    """AUC of telling a row's own class from another one, drawn by a seeded hash, by Mahalanobis distance under a shrunk covariance."""
    classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # the class list
    far = F.create_map(*[x for c in classes for x in (F.lit(c), models.mahalanobis_column(features, *models.shrunk_covariance(df.where(F.col(label) == c), features)[:2]))])
    others = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c != F.col(label))
    wrong = F.get(others, F.pmod(F.xxhash64(F.lit(seed), key), F.size(others)).cast("int"))
    pairs = df.select(F.explode(F.array(F.struct(F.lit(True).alias("own"), (-far[F.col(label)]).alias("score")), F.struct(F.lit(False).alias("own"), (-far[wrong]).alias("score")))).alias("p")).select("p.*")
    return stats.auc(pairs, "score", F.col("own"))


def controlled(df: DataFrame, feature: str, cells: Sequence[str]) -> DataFrame:
    """The feature less its cell's mean, plus the grand mean; a cell's effect is regressed out rather than scaled away."""
    means = df.groupBy(*cells).agg(F.avg(feature).alias("__cell"))
    grand = df.agg(F.avg(feature).alias("__grand"))
    return df.join(means, list(cells)).join(grand, F.lit(True)).withColumn(f"{feature}_controlled", F.col(feature) - F.col("__cell") + F.col("__grand")).drop("__cell", "__grand")


def position_folds(df: DataFrame, cell: Sequence[str], group: str, k: int) -> DataFrame:
    """Folds of whole (cell, run) groups, so that a held-out position is new to the model."""
    return folds.grouped(df.withColumn("__group", F.concat_ws("|", *cell, group)), "__group", k).drop("__group")


def medoids(df: DataFrame, label: str, features: Sequence[str], key: str) -> DataFrame:
    """For each class the row nearest to its mean (Euclidean), the smallest key of equals."""
    means = df.groupBy(label).agg(*[F.avg(f).alias(f"__m_{f}") for f in features])
    far = sum(((F.col(f) - F.col(f"__m_{f}")) ** 2 for f in features), F.lit(0.0))
    return df.join(means, label).groupBy(label).agg(F.min(F.struct(far.alias("far"), F.col(key).alias("key"))).alias("m")).select(label, F.col("m.key").alias(key), F.sqrt("m.far").alias("distance"))


def promotion(df: DataFrame, value: str, group: str, least_groups: int = 2) -> DataFrame:
    """A sub-cluster is promoted if its values are bimodal and each side is seen in enough groups."""
    middle = df.agg(F.median(value).alias("__mid"))
    sides = df.join(middle, F.lit(True)).groupBy((F.col(value) > F.col("__mid")).alias("upper")).agg(F.count_distinct(group).alias("groups"))
    bimodal = models.bimodality(df, value)["bimodal"]
    return sides.agg(F.min("groups").alias("least_groups")).withColumn("promoted", F.lit(bimodal) & (F.col("least_groups") >= least_groups))


def av_offset(df: DataFrame, key: str, at: str, audio: str, video: str, most: int) -> DataFrame:
    """For each key the lag of the video series (-most..most steps) with the largest correlation to the audio, the smallest of equals in size."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    a = df.select(key, F.col(at).alias("__t"), F.col(audio).alias("__a"))
    v = df.select(key, F.col(video).alias("__v"), F.col(at).alias("__s"), lags.alias("lag")).withColumn("__t", F.col("__s") - F.col("lag"))
    r = a.join(v, [key, "__t"]).groupBy(key, "lag").agg(F.corr("__a", "__v").alias("r"))
    return r.where("r is not null").groupBy(key).agg(F.max(F.struct("r", (-F.abs("lag")).alias("s"), (-F.col("lag")).alias("l"))).alias("m")).select(key, (-F.col("m.l")).alias("lag"), F.col("m.r").alias("r"))


def quarantine(runs: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs whose number of events is not the expected one or whose intent was not matched."""
    found = events.groupBy(*keys).agg(F.count("*").alias("detected"))
    met = runs.join(found, list(keys), "left").withColumn("detected", F.coalesce("detected", F.lit(0)))
    return met.withColumn("quarantined", F.coalesce(F.col("detected") != F.col("expected_note_count"), F.lit(False)) | F.coalesce(F.col("matched_intent") == "n", F.lit(False)))


def loudest_first(df: DataFrame, part: Sequence[str], weight: str, k: int) -> DataFrame:
    """O2: the ``k`` rows of largest |weight| in each part."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.abs(F.col(weight)).desc(), *[c for c in df.columns if c not in part]))).where(F.col("rank") <= k)
