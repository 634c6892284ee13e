"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import deal_pairs, smallest_linked, whole_groups
from tessera.llm.sampling import bounded_sample
from tessera.llm.vectors import in_order, is_valid, matrix, unit, unpack
from tessera.plans import connected_components, materialise, small_batches


def learn_rotation(rows: np.ndarray, bits: int, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dims x bits) of iterative quantisation.

    Centred vectors are projected on their main axes; then codes (signs) and the
    rotation that brings the projections closest to them are found in turn. The mean of
    a few rows says little of where vectors lie, so it is drawn towards the origin.
    """
    mean = rows.mean(axis=0) * len(rows) / (len(rows) + 64)
    _, _, axes = np.linalg.svd(rows - mean, full_matrices=True)
    axes = axes[:bits].T
    projected = (rows - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        codes = np.where(projected @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ projected)
        turn = (left @ right).T
    return mean, axes @ turn


def table_masks(bits: int, width: int, tables: int, seed: int = 11) -> list[int]:
    """A mask of ``width`` bits (half of all bits at the most) for each table; bits are dealt out anew once all are used."""
    width = min(width, max(1, bits // 2))
    if not width:
        return [0]
    rng, left, masks = np.random.default_rng(seed), [], []
    for _ in range(tables):
        if len(left) < width:
            left = rng.permutation(bits).tolist()
        masks.append(sum(1 << left.pop() for _ in range(width)))
    return masks


def to_codes(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pairs_at(rows: np.ndarray, threshold: float, n: int = 4096, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: a sampled row, and one turned away from it.

    A third turn towards another sampled row, a third by a difference of two sampled rows, a third anywhere, so
    vectors that share a direction yield pairs of their own kind. Pairs of the sample itself just above the threshold come on top.
    """
    rng, count = np.random.default_rng(seed), len(rows)
    x = rows[rng.integers(count, size=n)]
    others, more = rows[rng.integers(count, size=n)], rows[rng.integers(count, size=n)]
    kind = np.arange(n)[:, None] % 3
    z = np.where(kind == 0, others, np.where(kind == 1, others - more, rng.normal(size=x.shape)))
    z = z - (z * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(z, axis=1)
    x, z = x[length > 1e-9], z[length > 1e-9] / length[length > 1e-9, None]
    y = threshold * x + (1 - threshold**2) ** 0.5 * z
    some = rows[rng.permutation(count)[:2048]]
    near = some @ some.T
    a, b = np.nonzero(np.triu((near >= threshold) & (near < threshold + 0.02), 1))
    picked = rng.permutation(len(a))[:n]
    return np.vstack([x, some[a[picked]]]), np.vstack([y, some[b[picked]]])


def fit_tables(rows: np.ndarray, mean: np.ndarray, projection: np.ndarray, threshold: float, tables: int, recall: float) -> tuple[list[int], int]:
    """For masks of 1, 2, ... bits the fewest tables in which ``recall`` of ``pairs_at`` the threshold meet, and the Hamming radius.

    The list ends at the width that would need more than ``tables``; it is empty where vectors crowd so that
    no width will do. The radius holds every one of the pairs with two bits to spare.
    """
    x, y = pairs_at(rows, threshold)
    bits = projection.shape[1]
    if not len(x):
        return [], bits
    differ = to_codes((x - mean) @ projection >= 0) ^ to_codes((y - mean) @ projection >= 0)
    radius = min(bits, int(np.bitwise_count(differ).max()) + 2)
    needed: list[int] = []
    for width in range(1, bits // 2 + 1):
        apart, count = differ, 0
        for mask in table_masks(bits, width, tables):
            if len(apart) <= (1 - recall) * len(differ):
                break
            apart, count = apart[(apart & np.uint64(mask)) != 0], count + 1
        if len(apart) > (1 - recall) * len(differ):
            break
        needed.append(count)
    return needed, radius


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = 512, company: int = 256, recall: float = 0.999, sample: int = 8192, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors with equal, non-null labels and as many dimensions are linked when
    their cosine in double precision is ``threshold`` or more. Equal vectors
    fold into a class first. Each class gets a code of up to 64 bits: the rotation
    is learned on ``sample`` classes at the most (the documented bound), every class is
    indexed. Classes that agree on the bits of one of several masks meet in a bucket. Masks of w bits need as many tables
    as let ``recall`` of pairs at the threshold meet, measured on pairs made from the sample (``fit_tables``), ``tables`` at
    the most. In a label of n classes a class costs each table one row, which is as dear as comparing ``company``
    codes, and n / 2^w codes to compare; w is where that is least, so masks and tables grow with the logarithm of n. Where vectors
    crowd so that no width will do, the label is one bucket.

    Only codes travel to the buckets. There pairs that met in an earlier table or differ in more bits
    than any of the sample's pairs are out; the vectors of classes that still have a partner follow and
    are compared. A link is a pair within that radius whose cosine is high enough, wherever it meets, so links
    and components agree. Buckets larger than ``block`` are split
    into blocks, and block is held against block, so no bucket is gathered in one
    task and none is cut. A block returns a count and one representative a member, never its pairs.

    Null, empty, zero or non-finite vectors and null labels: 0 links, a component
    of their own. Rows of equal vec_id are one node. A null vec_id: component null.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_valid(F.col("embedding")))
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("dims", F.size("embedding")), "classes")
    per_dims = {r.dims: r.n for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = in_order(unit(matrix(group["embedding"])))
        mean, projection = learn_rotation(found, min(64, found.shape[1]))
        needed, radius = fit_tables(found, mean, projection, threshold, tables, recall)
        return pd.DataFrame({"dims": [key[0]], "mean": [mean.tolist()], "projection": [projection.ravel().tolist()], "needed": [needed], "radius": [radius]})

    drawn = bounded_sample(classes, "dims", per_dims, ["rep"], sample, 3)
    learned = drawn.groupBy("dims").applyInPandas(learn, "dims int, mean array<double>, projection array<double>, needed array<int>, radius int").collect()  # dims x 64 numbers each
    models = {r.dims: (np.array(r.mean), np.array(r.projection).reshape(r.dims, -1)) for r in learned}
    masks = {(r.dims, 0): [0] for r in learned}
    masks |= {(r.dims, w): table_masks(min(64, r.dims), w, n) for r in learned for w, n in enumerate(r.needed, 1)}
    radii = {r.dims: r.radius for r in learned}
    packed = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, group in batch.groupby("dims"):
                raw = matrix(group["embedding"])
                mean, projection = models[dims]
                codes = to_codes((unit(raw) - mean) @ projection >= 0)
                yield pd.DataFrame({"label": group["label"].to_numpy(), "dims": dims, "rep": group["rep"].to_numpy(), "copies": group["copies"].to_numpy(), "code": codes.view(np.int64), "vector": [v.tobytes() for v in raw.astype(packed)]})

    label = dict(classes.dtypes)["label"]
    codes = materialise(classes.mapInPandas(encode, f"label {label}, dims int, rep bigint, copies bigint, code bigint, vector binary"), "codes")
    sizes = codes.groupBy("label", "dims").agg(F.count("*").alias("n"))
    needed = vectors.sparkSession.createDataFrame([(r.dims, r.needed) for r in learned], "dims int, needed array<int>")
    cost = F.transform("needed", lambda count, i: F.struct((count * (company + F.col("n") / F.pow(F.lit(2.0), i + 1))).alias("cost"), (i + 1).alias("width")))
    widths = sizes.join(F.broadcast(needed), "dims").select("label", "dims", F.coalesce(F.array_min(cost)["width"], F.lit(0)).alias("width"))
    all_masks = vectors.sparkSession.createDataFrame([(d, w, t, _signed(m)) for (d, w), found in masks.items() for t, m in enumerate(found)], "dims int, width int, table int, mask bigint")  # at most 32 x ``tables`` a length
    keyed = codes.select("label", "dims", "rep", "code").join(materialise(widths, "widths"), ["label", "dims"]).join(F.broadcast(all_masks), ["dims", "width"])
    keyed = keyed.withColumn("part", F.col("code").bitwiseAND(F.col("mask"))).drop("mask")
    bucket = ["label", "dims", "width", "table", "part"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in whole_groups(batches, [*bucket, "low", "high"]):
            yield batch.iloc[_partnered(batch, starts, masks, radii)][[*bucket, "rep"]]

    met = deal_pairs(keyed, bucket, F.xxhash64("rep"), block).mapInPandas(meet, f"label {label}, dims int, width int, table int, part bigint, rep bigint")
    met = materialise(met.dropDuplicates([*bucket, "rep"]), "met")
    dealt = deal_pairs(met.join(codes.select("rep", "copies", "code", "vector"), "rep"), bucket, F.xxhash64("rep"), block)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in whole_groups(batches, [*bucket, "low", "high"]):
            yield _linked(batch, starts, masks, radii, threshold, packed)

    found = materialise(dealt.mapInPandas(compare, "rep bigint, links bigint, other bigint"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    of_class = classes.select("label", "embedding", "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    tagged = valid.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_valid(F.col("embedding")))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return tagged.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _partnered(batch: pd.DataFrame, starts: np.ndarray, masks: dict[tuple[int, int], list[int]], radii: dict[int, int], small: int = 64) -> np.ndarray:
    """Places of the members that have a partner within the radius whom no earlier table brings to them.

    Groups of up to ``small`` members are held against themselves all at once, at one distance in the
    batch after the other; larger ones each as a matrix.
    """
    own, low, high, table, dims, width = (batch[c].to_numpy() for c in ("own", "low", "high", "table", "dims", "width"))
    code, found = batch["code"].to_numpy().view(np.uint64), np.zeros(len(batch), bool)
    radius = np.array([radii[int(d)] for d in np.unique(dims)])[np.searchsorted(np.unique(dims), dims)]
    kinds, kind = np.unique(np.stack([dims, width], axis=1), axis=0, return_inverse=True)
    kind = kind.ravel()
    earlier = [np.array(masks[int(d), int(w)], np.uint64) for d, w in kinds]

    def settle(at: np.ndarray, to: np.ndarray) -> None:
        """Mark the pairs' members unless an earlier table's bucket holds the pair."""
        left = code[at] ^ code[to]
        for k in np.unique(kind[at]):
            for t in range(len(earlier[k])):
                stay = (kind[at] != k) | (table[at] <= t) | ((left & earlier[k][t]) != 0)
                if not stay.all():
                    at, to, left = at[stay], to[stay], left[stay]
                if not len(at) or table[at].max() <= t:
                    break
        found[at] = found[to] = True

    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    little = sizes[group] <= small
    for gap in range(1, int(sizes[sizes <= small].max(initial=1))):
        at = np.flatnonzero(little[:-gap] & (group[:-gap] == group[gap:]))
        at = at[(np.bitwise_count(code[at] ^ code[at + gap]) <= radius[at]) & ((low[at] == high[at]) | (own[at] != own[at + gap]))]
        settle(at, at + gap)
    for a, b in zip(starts[:-1][sizes > small], starts[1:][sizes > small]):
        near = np.triu(np.bitwise_count(code[a:b, None] ^ code[None, a:b]) <= radius[a], 1)
        if low[a] != high[a]:
            near &= own[a:b, None] != own[None, a:b]
        at, to = np.nonzero(near)
        settle(a + at, a + to)
    return np.flatnonzero(found)


def _linked(batch: pd.DataFrame, starts: np.ndarray, masks: dict[tuple[int, int], list[int]], radii: dict[int, int], threshold: float, packed_as: str) -> pd.DataFrame:
    """For each linked member of the groups between ``starts``: links first met here, and its group's smallest class."""
    reps, links, others = [], [], []
    if len(batch):
        rep, copies, own = (batch[c].to_numpy() for c in ("rep", "copies", "own"))
        low, high, table, dims, width = (batch[c].to_numpy() for c in ("low", "high", "table", "dims", "width"))
        code, packed = batch["code"].to_numpy().view(np.uint64), batch["vector"].to_numpy()
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a < 2:
                continue
            vectors = unit(unpack(packed[a:b], packed_as))
            near = vectors @ vectors.T >= threshold
            near &= np.bitwise_count(code[a:b, None] ^ code[None, a:b]) <= radii[int(dims[a])]
            np.fill_diagonal(near, False)
            if low[a] != high[a]:  # two blocks: pairs inside a block are met elsewhere
                near &= own[a:b, None] != own[None, a:b]
            at, to = np.nonzero(near)
            if not len(at):
                continue
            masked = np.array(masks[int(dims[a]), int(width[a])][: int(table[a])], np.uint64)
            differ = code[a + at] ^ code[a + to]
            first = ~((differ[:, None] & masked[None, :]) == 0).any(axis=1)
            count = np.bincount(at[first], weights=copies[a + to[first]], minlength=b - a).astype(np.int64)
            group = smallest_linked(rep[a:b], near)
            some = np.flatnonzero(near.any(axis=1))
            reps.append(rep[a:b][some])
            links.append(count[some])
            others.append(group[some])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"rep": join(reps), "links": join(links), "other": join(others)})
