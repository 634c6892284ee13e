"""Data quality: rates with status, counts against expectations, label agreement, coverage, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import status_band


def flag_rates(df: DataFrame, flags: dict[str, Column], run: Sequence[str], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(flag, n, percent, bad_runs, status), one row a flag from one scan; a missing flag counts as false."""
    cells = F.array(*[F.struct(F.lit(name).alias("flag"), F.coalesce(flag, F.lit(False)).alias("on")) for name, flag in flags.items()])
    long = df.select(F.struct(*run).alias("run"), F.explode(cells).alias("c"))
    rates = long.groupBy("c.flag").agg(F.count("*").alias("n"), (100 * F.avg(F.col("c.on").cast("double"))).alias("percent"), F.count_distinct(F.when(F.col("c.on"), F.col("run"))).alias("bad_runs"))
    status = F
    for name, (red, amber) in limits.items():
        status = status.when(F.col("flag") == name, status_band(F.col("percent"), red, amber))
    return rates.withColumn("status", status.otherwise("green") if limits else F.lit("green"))


def count_audit(runs: DataFrame, events: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Detected against expected events of every run; a mismatch only where something is expected."""
    found = events.groupBy(*keys).agg(F.count("*").alias("detected"))
    met = runs.select(*keys, F.col(expected).alias("expected")).join(found, list(keys), "left").withColumn("detected", F.coalesce("detected", F.lit(0)))
    return met.withColumn("mismatch", F.coalesce((F.col("expected") > 0) & (F.col("detected") != F.col("expected")), F.lit(False)))


def agreement(df: DataFrame, run: Sequence[str], match: Column) -> DataFrame:
    """For each run the share of matches among the rows that have a verdict; null if none has."""
    return df.groupBy(*run).agg(F.avg(match.cast("double")).alias("rate"), F.count(match).alias("judged"))


def worst(rates: DataFrame, run: Sequence[str], n: int = 5) -> DataFrame:
    """O1: the ``n`` runs of lowest agreement below 1, ties by run."""
    return rates.where("rate < 1").orderBy("rate", *run).limit(n)


def coverage_grid(df: DataFrame, dims: Sequence[tuple[str, Sequence]], target: int = 8) -> DataFrame:
    """Counts of every cell of a grid of given values, empty ones included, with state full, thin or empty."""
    spark = df.sparkSession
    grid = spark.range(1).select()
    for name, values in dims:
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))  # as many rows as the grid has cells
    counts = df.groupBy(*[n for n, _ in dims]).agg(F.count("*").alias("n"))
    met = grid.join(counts, [n for n, _ in dims], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return met.withColumn("state", F.when(F.col("n") >= target, "full").when(F.col("n") > 0, "thin").otherwise("empty"))


def thinnest(grid: DataFrame, order: Sequence[Column], n: int = 2) -> DataFrame:
    """The ``n`` cells of least count, ties by ``order``."""
    return grid.orderBy("n", *order).limit(n)


def tallies(grid: DataFrame) -> DataFrame:
    """How many cells are full, thin and empty."""
    return grid.agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("full", "thin", "empty")])


def recommendations(facts: DataFrame, rules: Sequence[tuple[int, str, Column]], default: str, most: int = 4) -> DataFrame:
    """Advice of the rules that hold for a one-row frame of facts, by priority, at most ``most``; the default if none holds."""
    cells = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(text).alias("advice"), F.coalesce(rule, F.lit(False)).alias("holds")) for p, text, rule in rules])
    held = F.slice(F.array_sort(F.filter(cells, lambda c: c["holds"])), 1, most)
    none = F.array(F.struct(F.lit(0).alias("priority"), F.lit(default).alias("advice"), F.lit(True).alias("holds")))
    return facts.select(F.explode(F.when(F.size(held) > 0, held).otherwise(none)).alias("r")).select("r.priority", "r.advice")


def session_status(df: DataFrame, session: Sequence[str], run: str, clipped: Column, silent: Column, cell: Column) -> DataFrame:
    """Runs, clipped and silent rows, and a map of cell counts, for each session."""
    per_cell = df.groupBy(*session, cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(clipped).alias("clipped"), F.count_if(silent).alias("silent"))
    runs = df.groupBy(*session).agg(F.count_distinct(run).alias("runs"))
    folded = per_cell.groupBy(*session).agg(F.sum("n").alias("events"), F.sum("clipped").alias("clipped"), F.sum("silent").alias("silent"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell", "n")))).alias("coverage"))  # a cell for each class
    return folded.join(runs, list(session))


def status_counts(df: DataFrame, status: Column) -> DataFrame:
    """Rows of each status."""
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
