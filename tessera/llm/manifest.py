"""Merkle manifest of a dataset: levels of nodes in Parquet, proofs by coordinate."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans import materialise
from tessera.plans.workspace import new_path

#: Fixed by the task's contract: the fields of a leaf, in order, and the children of a node.
FIELDS, WIDTH = ("doc_id", "source", "lang", "n_chars", "text"), 3
_NODE = "tree string, level int, idx bigint, depth int, node string"
_PATH = "lefts array<string>, rights array<string>"


def leaf_of(values: Sequence[Column]) -> Column:
    """H of the values in order, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    written = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _above(nodes: list[str]) -> list[str]:
    return [_hash("".join(nodes[i : i + WIDTH])) for i in range(0, len(nodes), WIDTH)]


class NodeStore:
    """Nodes (tree, level, idx, depth, node) in one Parquet table, partitioned by level, in the shared folder.

    A node's children are ``WIDTH`` consecutive nodes of the level below. A round reads one level in
    runs of WIDTH ** ``step`` nodes, each sorted and read once from start to end, and writes the ``step`` levels
    above it; so a run is all that a task holds, and a tree of n leaves takes log(n) / step rounds.
    """

    def __init__(self, spark: SparkSession, step: int) -> None:
        self.spark, self.step, self.path, self.rounds = spark, step, new_path(spark, "nodes"), 0

    def level(self, level: int) -> DataFrame:
        return self.all().where(F.col("level") == level)

    def all(self) -> DataFrame:
        return self.spark.read.schema(_NODE).parquet(self.path)

    def _add(self, nodes: DataFrame) -> None:
        nodes.write.mode("append").partitionBy("level").parquet(self.path)

    def build(self, leaves: DataFrame) -> None:
        """From leaves (tree, idx, node, depth) up to each tree's only node, at level ``depth``."""
        self._add(leaves.select("tree", F.lit(0).alias("level"), "idx", "depth", "node"))
        deepest = leaves.agg(F.max("depth")).first()[0] or 0
        for low in range(0, deepest, self.step):
            runs = self.level(low).where(F.col("depth") > low).withColumn("run", F.floor(F.col("idx") / WIDTH**self.step))
            self._add(runs.groupBy("tree", "run").applyInPandas(functools.partial(_levels, low=low, step=self.step), _NODE))
        self.rounds = max(1, -(-deepest // self.step))

    def roots(self) -> DataFrame:
        """(tree, root) of every tree."""
        return self.all().where("level = depth and idx = 0").select("tree", F.col("node").alias("root"))

    def paths(self, outer: DataFrame) -> DataFrame:
        """(tree, run, lefts, rights): for each run of leaves the siblings above it, upwards, left and right of the path.

        ``outer`` (tree, lefts, rights) goes on from each tree's root. From the highest round down, the
        nodes of a run meet the path above the run by their coordinate (a merge of two sorted tables).
        """
        known = None
        for turn in range(self.rounds - 1, -1, -1):
            low, high = turn * self.step, (turn + 1) * self.step
            ends = self.level(low).where((F.col("depth") <= high) & ((F.col("depth") > low) | F.lit(turn == 0)) & (F.col("idx") == 0)).select("tree")
            tops = outer.join(ends, "tree").select("tree", F.lit(0).cast("bigint").alias("run"), "lefts", "rights")
            known = tops if known is None else tops.unionByName(known)
            if turn == 0:
                return known
            known = materialise(known, "paths")
            nodes = self.level(low).where(F.col("depth") > low).withColumn("run", F.floor(F.col("idx") / WIDTH**self.step))
            met = nodes.groupBy("tree", "run").cogroup(known.groupBy("tree", "run"))
            known = met.applyInPandas(functools.partial(_run_paths, low=low, step=self.step), f"tree string, run bigint, {_PATH}")


def _sorted_run(nodes: pd.DataFrame, low: int, step: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A run by idx, and its levels from the lowest up."""
    nodes = nodes.sort_values("idx", ignore_index=True)
    levels = [nodes.node.tolist()]
    for _ in range(min(step, int(nodes.depth[0]) - low)):
        levels.append(_above(levels[-1]))
    return nodes, levels


def _levels(nodes: pd.DataFrame, low: int, step: int) -> pd.DataFrame:
    nodes, levels = _sorted_run(nodes, low, step)
    first, rows = int(nodes.idx[0]), []
    for k, above in enumerate(levels[1:], 1):
        rows += [(nodes.tree[0], low + k, first // WIDTH**k + i, int(nodes.depth[0]), node) for i, node in enumerate(above)]
    return pd.DataFrame(rows, columns=["tree", "level", "idx", "depth", "node"])


def _siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """For a run's node ``at``, level by level, what stands left and right of the path inside each group."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        start = at - at % WIDTH
        lefts.append("".join(nodes[start:at]))
        rights.append("".join(nodes[at + 1 : start + WIDTH]))
        at //= WIDTH
    return lefts, rights


def _run_paths(nodes: pd.DataFrame, above: pd.DataFrame, low: int, step: int) -> pd.DataFrame:
    nodes, levels = _sorted_run(nodes, low, step)
    outer_left, outer_right = list(above.lefts[0]), list(above.rights[0])
    rows = []
    for k, at in enumerate(nodes.idx.tolist()):
        lefts, rights = _siblings(levels, k)
        rows.append((nodes.tree[0], at, lefts + outer_left, rights + outer_right))
    return pd.DataFrame(rows, columns=["tree", "run", "lefts", "rights"])


def _proved(nodes: pd.DataFrame, above: pd.DataFrame, step: int) -> pd.DataFrame:
    """Each leaf's proof digest, and the root that the leaf as shown and its siblings give."""
    nodes, levels = _sorted_run(nodes, 0, step)
    outer_left, outer_right = list(above.lefts[0]), list(above.rights[0])
    proofs, folded = [], []
    for k, (leaf, shown) in enumerate(zip(nodes.node.tolist(), nodes.shown.tolist(), strict=True)):
        lefts, rights = _siblings(levels, k)
        lefts, rights = lefts + outer_left, rights + outer_right
        value = leaf if shown is None else shown
        for left, right in zip(lefts, rights, strict=True):
            value = _hash(left + value + right)
        proofs.append(_hash("".join(a + b for a, b in zip(lefts, rights, strict=True))))
        folded.append(value)
    out = nodes[["doc_id", "node", "tree"]].rename(columns={"node": "leaf"})
    return out.assign(proof_sha256=proofs, folded_root=folded)


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx, their rank by ``order`` in their tree, and depth, the levels above the tree's leaves.

    Rows are written as runs in the order (tree, ``order``); a rank is the place in the run and the sum
    of the earlier runs' counts, so no tree is sorted in one task.
    """
    by = ["tree", *order]
    runs = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    runs = materialise(runs.withColumn("run", F.shiftright(place, 33).cast("int")).withColumn("place", place.bitwiseAND((1 << 33) - 1)), "runs")
    parts = runs.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    tree = Window.partitionBy("tree")
    upto = tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(tree)
    depth = F.coalesce(*[F.when(total <= WIDTH**d, F.lit(d)) for d in range(40)])
    parts = materialise(parts.select("tree", "run", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("start")).alias("shift"), depth.alias("depth")), "parts")
    return runs.join(parts, ["tree", "run"]).withColumn("idx", F.col("place") + F.col("shift")).drop("run", "place", "shift")


def merkle_manifest(docs: DataFrame, shown: Column, fields: Sequence[str] = FIELDS, step: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    A leaf hashes the row's ``fields`` (``leaf_of``). A tree for each source has its leaves by doc_id, its
    groups of three in order, and its only node left is the subroot; the subroots by source (null first, bytewise) give the
    root likewise. A proof is the siblings from the leaf to the root, left to right. ``shown`` is the text that a
    holder of the row presents: folded_root comes from the leaf with it and the original siblings,
    verified says that it is the root.

    Text is read once and hashed where it lies; what moves is a digest a row. Nodes live in two
    ``NodeStore`` tables; proofs are made run by run and never leave their task but as digests.

    Rows that repeat a doc_id stand in the order of their leaves; null doc_ids come first. Nulls in
    other fields are part of the leaf. Further columns are ignored. Empty in, empty out.
    """
    spark, values = docs.sparkSession, {f: F.col(f) for f in fields}
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # "-" sorts before "="
    changed = leaf_of([shown if f == "text" else values[f] for f in fields])
    same = shown.eqNullSafe(F.col("text"))
    leaves = materialise(docs.select("doc_id", source.alias("tree"), leaf_of(list(values.values())).alias("node"), F.when(~same, changed).alias("shown")), "leaves")
    ranked = materialise(_ranked(leaves, ["doc_id", "node"]), "ranked")
    store = NodeStore(spark, step)
    store.build(ranked)
    subroots = materialise(store.roots(), "subroots")

    tops = materialise(_ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")), ["source"]), "tops")
    upper = NodeStore(spark, step)
    upper.build(tops)
    none = F.array().cast("array<string>")
    above = upper.paths(upper.roots().select("tree", none.alias("lefts"), none.alias("rights")))
    tops = tops.withColumn("run", F.floor(F.col("idx") / WIDTH**step))
    met = tops.groupBy("tree", "run").cogroup(above.groupBy("tree", "run"))
    outer = met.applyInPandas(functools.partial(_source_paths, step=step), f"tree string, {_PATH}")
    above = store.paths(materialise(outer, "outer"))

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    runs = ranked.withColumn("run", F.floor(F.col("idx") / WIDTH**step))
    met = runs.groupBy("tree", "run").cogroup(above.groupBy("tree", "run"))
    proved = met.applyInPandas(functools.partial(_proved, step=step), f"doc_id {kind}, leaf string, tree string, proof_sha256 string, folded_root string")
    root = F.lit(next((r.root for r in upper.roots().collect()), None)).cast("string")  # one row, or none
    out = proved.join(subroots.withColumnRenamed("root", "subroot"), "tree")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _source_paths(nodes: pd.DataFrame, above: pd.DataFrame, step: int) -> pd.DataFrame:
    """The path from each subroot to the root, under its source."""
    named = dict(zip(nodes.idx, nodes.source, strict=True))
    found = _run_paths(nodes, above, 0, step)
    return found.assign(tree=found.run.map(named))[["tree", "lefts", "rights"]]
