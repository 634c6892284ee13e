"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import materialise

#: Fixed by the task's contract: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as bigint; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_order(doc_id: Column, seed: int) -> Column:
    """60 evenly spread bits of md5(seed:doc_id); a null id counts as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): the words to take from each source.

    ``sizes`` has source and source_size. The j-th source by code point, null
    last, weighs ``weights[(j - 1) % len]`` and they share ``budget`` of all
    words. Clamping at ``max_epochs`` and resharing the excess by weight ends at
    one water level: target = min(cap, level * weight). Sources are looked at by
    the level at which they fill; the first that does not fill below the level
    that the rest would reach fixes it. Sources without words get 0; if all
    sources are full, each gets its cap.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"), (F.lit(float(budget)) * F.sum("source_size").over(Window.partitionBy())).alias("want"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumn("level", (F.col("want") - full) / rest)
    holds = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(holds, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("rank").alias("r"), F.col("level").alias("level")))).over(Window.partitionBy())
    found = levels.withColumn("water", level["level"])
    return found.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 7, bins: int = 4096) -> DataFrame:
    """How often each document enters the mix.

    Takes doc_id, text, source; returns doc_id, source, size, source_size, target,
    repeats (times the document is taken) and taken = repeats * size. Every
    document of a source is taken floor(target / source_size) times. For the
    fraction that is left, documents stand in a seeded order (md5 of seed and
    doc_id) and are taken until the quota is met; the one that crosses it is taken
    if more than half of it fits. The running sum is first taken over ``bins``
    ranges of that order, so only a source's one crossing range is sorted, and a
    hot source is never gathered in a task. Last, the one row whose change brings
    the source closest to its target is turned over, if any does; among rows that agree in
    doc_id and size it does not matter which.

    Null texts and texts without words have size 0; null source is a source of
    its own, last in order; rows that repeat are rows of their own. An empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    sized = materialise(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), seeded_order(F.col("doc_id"), seed).alias("h"), F.monotonically_increasing_id().alias("row")).withColumn("bin", F.pmod("h", F.lit(bins)).cast("int")),
        "sized",
    )
    per_bin = materialise(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    targets = source_targets(per_bin.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = targets.withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("words").over(upto), F.lit(0))
    crossing = (
        per_bin.withColumn("start", start)
        .join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .where("start <= quota and quota < start + words")
        .groupBy(F.col("source").alias("at"))
        .agg(F.max(F.struct("bin", "start")).alias("x"))
    )
    per_source = materialise(
        plan.join(crossing, F.col("source").eqNullSafe(F.col("at")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "quota", F.coalesce(F.col("x.bin"), F.lit(bins)).alias("cross_bin"), F.coalesce(F.col("x.start"), F.lit(0)).alias("cross_start")),
        "sources",
    )
    rows = sized.join(per_source, F.col("source").eqNullSafe(F.col("of")))
    inside = Window.partitionBy("source").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("cross_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = rows.where("bin = cross_bin").withColumn("extra", (before + F.col("size") / 2 <= F.col("quota")) & (F.col("quota") > 0))
    rest = rows.where("bin <> cross_bin").withColumn("extra", (F.col("bin") < F.col("cross_bin")) & (F.col("quota") > 0))
    drawn = materialise(rest.unionByName(edge), "drawn")

    gaps = drawn.groupBy(F.col("source").alias("of2")).agg((F.max("quota") - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).alias("gap"), F.max("quota").alias("q2"))
    gaps = materialise(gaps, "gaps")
    change = F.when(F.col("extra"), -F.col("size")).otherwise(F.col("size"))
    off = F.abs(F.col("gap") - change)
    best = drawn.join(gaps, F.col("source").eqNullSafe(F.col("of2"))).where((F.col("q2") > 0) & (off < F.abs("gap"))).groupBy(F.col("source").alias("of3")).agg(F.min(F.struct(off.alias("off"), "h", "doc_id", "size", "row")).alias("best"))
    turned = materialise(best.select("of3", F.col("best.row").alias("turn")), "turned")
    final = drawn.join(turned, F.col("source").eqNullSafe(F.col("of3")) & (F.col("row") == F.col("turn")), "left")
    repeats = F.col("whole") + F.when(F.col("turn").isNull(), F.col("extra")).otherwise(~F.col("extra")).cast("bigint")
    return final.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
