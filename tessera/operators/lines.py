"""Straight lines among edge points: votes over angle and offset, and the peaks of that grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import materialise


def vote_grid(points: DataFrame, frame: Sequence[str], angles: int = 180, step: float = 1.0, weight: Column | None = None) -> DataFrame:
    """(``frame``, angle, offset, votes): for each of ``angles`` directions how many points (x, y) lie on a line of offset about ``offset`` * ``step``.

    A point votes once a direction, for x cos + y sin to the nearest step, half up; angle k stands for k * pi / ``angles``.
    Votes are partial aggregates: a point becomes ``angles`` numbers in its own task and meets the rest as counts, so a frame with a
    third of all points shuffles its grid a task and no more. Points with a missing or non-finite coordinate do not vote; ``weight`` instead
    of 1 a point, null for none.
    """
    def whole(c: str) -> Column:
        return F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))  # NaN is above all numbers

    w = F.lit(1) if weight is None else weight
    rows = points.where(whole("x") & whole("y")).select(*frame, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w"))
    votes = rows.select(*frame, "x", "y", "w", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("angle"))
    turn = F.col("angle") * F.lit(3.141592653589793 / angles)
    offset = F.floor((F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn)) / step + 0.5)
    return votes.groupBy(*frame, "angle", offset.cast("bigint").alias("offset")).agg(F.sum("w").alias("votes")).where("votes > 0")


def grid_peaks(grid: DataFrame, frame: Sequence[str], angles: int, near_angle: int = 3, near_offset: int = 5, least: float = 2.0) -> DataFrame:
    """The cells with ``least`` votes or more that no cell nearby beats; of equals the smaller (angle, offset) stays.

    Nearby is within ``near_angle`` directions and ``near_offset`` steps; past the last direction the grid goes on at the first with the offset turned
    over. Cells meet in blocks as large as the neighbourhood: a cell sends itself to the blocks that it reaches, nine at the most. The strong cells are written once, and
    both sides are sorted by block: the planner takes copies for as few as what they are made of, and would gather them in the driver for a broadcast.
    """
    strong = materialise(grid.where(F.col("votes") >= least), "cells")
    rank = F.struct(F.col("votes").cast("double").alias("votes"), (-F.col("angle")).alias("a"), (-F.col("offset")).alias("o"))
    # the grid's seam: copies on the other side
    seam = F.array(F.struct(F.lit(0).alias("da"), F.lit(1).alias("sign")), F.struct(F.lit(angles).alias("da"), F.lit(-1).alias("sign")), F.struct(F.lit(-angles).alias("da"), F.lit(-1).alias("sign")))
    copies = strong.select(*frame, rank.alias("rank"), "angle", "offset", F.explode(seam).alias("s")).select(*frame, "rank", (F.col("angle") + F.col("s.da")).alias("at_angle"), (F.col("offset") * F.col("s.sign")).alias("at_offset"))
    copies = copies.where(F.col("at_angle").between(-near_angle, angles - 1 + near_angle))
    high, wide = near_angle + 1, near_offset + 1
    block = lambda c, size: F.floor(c / size).cast("bigint")
    around = lambda b: F.explode(F.sequence(b - 1, b + 1))
    sent = copies.select(*frame, "rank", "at_angle", "at_offset", around(block(F.col("at_angle"), high)).alias("ba"))
    sent = sent.select(*frame, "rank", "at_angle", "at_offset", "ba", around(block(F.col("at_offset"), wide)).alias("bo"))
    # a block's best few settle most cells; what they do not reach is compared cell by cell
    own = strong.select(*frame, "angle", "offset", "votes", rank.alias("own"), block(F.col("angle"), high).alias("ba"), block(F.col("offset"), wide).alias("bo"))
    met = own.hint("merge").join(sent, [*frame, "ba", "bo"]).where((F.abs(F.col("at_angle") - F.col("angle")) <= near_angle) & (F.abs(F.col("at_offset") - F.col("offset")) <= near_offset))
    beaten = met.groupBy(*frame, "angle", "offset", "votes").agg(F.max("rank").alias("best"), F.max("own").alias("own"))
    return beaten.where(F.col("best") == F.col("own")).select(*frame, "angle", "offset", "votes")


def neck_edges(points: DataFrame, frame: Sequence[str], angles: int = 180, step: float = 1.0, least: float = 2.0, parallel: int = 4) -> DataFrame:
    """The two strongest lines of each frame that run parallel: (``frame``, angle_a, offset_a, angle_b, offset_b, votes).

    Candidates are the grid's peaks; two belong together if their directions differ by ``parallel`` steps at the most, over the grid's seam
    with the second offset turned over. The pair with most votes wins, of equals the one with the smallest angles and offsets. Frames without such
    a pair have no row. A frame's peaks are few: a line suppresses its surroundings.
    """
    peaks = materialise(grid_peaks(vote_grid(points, frame, angles, step), frame, angles, least=least), "peaks")
    a = peaks.select(*frame, F.col("angle").alias("angle_a"), F.col("offset").alias("offset_a"), F.col("votes").alias("votes_a"))
    b = peaks.select(*frame, F.col("angle").alias("angle_b"), F.col("offset").alias("offset_b"), F.col("votes").alias("votes_b"))
    gap = F.abs(F.col("angle_a") - F.col("angle_b"))
    pairs = a.hint("merge").join(b, list(frame)).where((F.struct("angle_a", "offset_a") < F.struct(F.col("angle_b").alias("angle_a"), F.col("offset_b").alias("offset_a"))) & ((gap <= parallel) | (gap >= angles - parallel)))
    best = F.max(F.struct((F.col("votes_a") + F.col("votes_b")).alias("votes"), (-F.col("angle_a")).alias("a"), (-F.col("offset_a")).alias("b"), (-F.col("angle_b")).alias("c"), (-F.col("offset_b")).alias("d")))
    found = pairs.groupBy(*frame).agg(best.alias("p"))
    return found.select(*frame, *[(-F.col(f"p.{k}")).alias(n) for k, n in (("a", "angle_a"), ("b", "offset_a"), ("c", "angle_b"), ("d", "offset_b"))], F.col("p.votes").alias("votes"))
