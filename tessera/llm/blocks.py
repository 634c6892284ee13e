"""Pairs inside large groups, block against block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import materialise


def deal_pairs(rows: DataFrame, keys: Sequence[str], spread: Column, block: int) -> DataFrame:
    """Rows of every group of ``keys`` with two members or more, dealt to pairs of blocks.

    A group of n rows falls into ceil(n / block) blocks by ``spread`` (a bigint hash);
    a row goes to its block's pair with every block: (low, high, own). A pair of rows
    of one block meets where low = high, any other pair where the blocks meet, so
    each meets once. Rows of a block pair stand together, sorted, in a partition.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")
    sizes = materialise(sizes.select(*keys, F.ceil(F.col("members") / block).cast("int").alias("blocks")), "groups")
    own = F.pmod(spread, F.col("blocks")).cast("int")
    met = rows.join(sizes, list(keys)).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "blocks")
    return paired.repartition(*keys, "low", "high").sortWithinPartitions(*keys, "low", "high")


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole groups of sorted rows, each with its groups' starts and the end; a group cut by a batch is carried on."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        batch = pd.concat([*held, batch], ignore_index=True) if held else batch
        same = np.ones(len(batch), bool)
        for k in keys:
            column = batch[k].to_numpy()
            same[1:] &= column[1:] == column[:-1]
        same[0] = False
        starts = np.flatnonzero(~same)
        held = [batch.iloc[starts[-1] :]]
        if starts[-1]:
            yield batch.iloc[: starts[-1]], starts
    if held:
        yield held[0].reset_index(drop=True), np.array([0, len(held[0])])


def smallest_linked(names: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each row the smallest name that it reaches by ``near`` (symmetric, without the diagonal)."""
    at, to = np.nonzero(near)
    group = names.copy()
    while True:
        after = group.copy()
        np.minimum.at(after, at, group[to])
        if (after == group).all():
            return group
        group = after
