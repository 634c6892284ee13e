"""Nearest neighbours: probed lists, scanned by adaptive dimension sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.sampling import bounded_sample, unit_hash
from tessera.llm.vectors import in_order, is_valid, matrix, unit, unpack
from tessera.plans import materialise, small_batches


@dataclass(frozen=True)
class Lists:
    """Unit centroids of the inverted lists, how many lists a query probes, and, where there are two levels, the coarse centroids and each list's own."""

    centres: np.ndarray
    probes: int = 1
    coarse: np.ndarray | None = None
    parent: np.ndarray | None = None

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The list of each unit row: that of its nearest centroid, on two levels among those of its nearest coarse one."""
        if self.coarse is None:
            return (rows @ self.centres.T).argmax(axis=1)
        top, out = (rows @ self.coarse.T).argmax(axis=1), np.zeros(len(rows), np.int64)
        for c in np.unique(top):
            own, at = np.flatnonzero(self.parent == c), np.flatnonzero(top == c)
            out[at] = own[(rows[at] @ self.centres[own].T).argmax(axis=1)] if len(own) else (rows[at] @ self.centres.T).argmax(axis=1)
        return out


def cluster(rows: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit ``rows``: ``k`` centroids, or one for every eight rows if that is less."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[: max(1, min(k, len(rows) // 8))]]
    for _ in range(12):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-12), centres)
    return centres


def fit_probes(rows: np.ndarray, lists: Lists, k: int, recall: float, seed: int = 7) -> int:
    """The least number of probed lists that reaches ``recall`` of the ``k`` nearest of up to 400 of the rows among the others."""
    near = lists.assign(rows)
    asked = np.random.default_rng(seed).permutation(len(rows))[:400]
    cosines = rows[asked] @ rows.T
    cosines[np.arange(len(asked)), asked] = -2
    best = np.argsort(-cosines, axis=1)[:, : min(k, max(1, len(rows) - 1))]
    order = np.argsort(np.argsort(-(rows[asked] @ lists.centres.T), axis=1), axis=1)
    rank = np.take_along_axis(order, near[best], axis=1)
    return min(len(lists.centres), int(np.quantile(rank, recall, method="higher")) + 1)


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random rotation: it spreads a distance evenly over the dimensions."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def scan(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: int, k: int, width: int, slack: float) -> np.ndarray:
    """Places of candidates that may be among the ``k`` nearest; rotated unit rows, one query.

    Squared distances grow column block by column block. After d of D dimensions a
    candidate is abandoned if the hypothesis that it lies within the k-th best
    distance r is rejected: partial * D / d > (r * (1 + slack / sqrt(d))) ** 2. r comes from
    whole distances and falls from chunk to chunk of candidates.
    """
    dims, chunk = rows.shape[1], 1024
    bound, kept, far = np.inf, [], []
    for at in range(0, len(rows), chunk):
        live = np.arange(at, min(len(rows), at + chunk))
        live = live[ids[live] != own]
        partial = np.zeros(len(live))
        for d in range(0, dims, width):
            delta = rows[live, d : d + width] - query[d : d + width]
            partial += np.einsum("ij,ij->i", delta, delta)
            seen = min(dims, d + width)
            if np.isfinite(bound):
                share = 1.0 if seen == dims else (1 + slack / seen**0.5) ** 2 * seen / dims
                stay = partial <= bound * share + 1e-12
                live, partial = live[stay], partial[stay]
        kept.append(live)
        far.append(partial)
        whole = np.concatenate(far)
        if len(whole) >= k:
            bound = np.partition(whole, k - 1)[k - 1]
    places, whole = np.concatenate(kept), np.concatenate(far)
    return places[whole <= bound + 1e-9]


def fit_lists(rows: DataFrame, counts: dict[int, int], k: int, recall: float, sample: int, lists: int | None, flat: int, numbers: int) -> dict[int, Lists]:
    """Lists for the vectors (dims, vec_id, embedding) of each length; see ``search``."""
    wanted = {d: max(1, min(lists or max(64, math.ceil(n**0.5)), max(flat, numbers // d))) for d, n in counts.items()}
    drawn = materialise(bounded_sample(rows.select("dims", "vec_id", "embedding"), "dims", counts, ["vec_id", "embedding"], sample, 3).select("dims", "embedding"), "sample")

    def first(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        want = wanted[key[0]]
        centres = cluster(in_order(unit(matrix(group["embedding"]))), want if want <= flat else math.ceil(want**0.5))
        return pd.DataFrame({"dims": [key[0]], "centres": [centres.ravel().tolist()]})

    found = {r.dims: np.array(r.centres).reshape(-1, r.dims) for r in drawn.groupBy("dims").applyInPandas(first, "dims int, centres array<double>").collect()}  # sqrt(lists) or flat x dims numbers each
    models = {d: Lists(found[d] if d in found else np.eye(1, d)) for d in counts}
    deep = [d for d in counts if wanted[d] > flat]
    if deep:
        # the second level: under each coarse centroid, from some 16 rows for every list, each in a task of its own
        def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dims, group in batch.groupby("dims"):
                    top = (unit(matrix(group["embedding"])) @ models[dims].centres.T).argmax(axis=1)
                    yield pd.DataFrame({"dims": dims, "coarse": top, "embedding": group["embedding"].to_numpy()})

        def second(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            centres = cluster(in_order(unit(matrix(group["embedding"]))), math.ceil(wanted[key[0]] ** 0.5))
            return pd.DataFrame({"dims": [key[0]], "coarse": [key[1]], "centres": [centres.ravel().tolist()]})

        rate = F.element_at(F.create_map(*[F.lit(x) for d in deep for x in (d, min(1.0, 16 * wanted[d] / max(1, counts[d])))]), F.col("dims"))
        more = rows.where(F.col("dims").isin(deep)).where(unit_hash(5, "vec_id", "embedding") < rate)
        fine = more.select("dims", "embedding").mapInPandas(coarse, "dims int, coarse int, embedding array<double>").groupBy("dims", "coarse").applyInPandas(second, "dims int, coarse int, centres array<double>")
        rows_ = sorted(fine.collect(), key=lambda r: (r.dims, r.coarse))  # ``numbers`` numbers each at the most
        for d in deep:
            own = [(r.coarse, np.array(r.centres).reshape(-1, d)) for r in rows_ if r.dims == d]
            if own:
                models[d] = Lists(np.vstack([c for _, c in own]), 1, models[d].centres, np.concatenate([np.full(len(c), top) for top, c in own]))

    def last(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dims": [key[0]], "probes": [fit_probes(in_order(unit(matrix(group["embedding"]))), models[key[0]], k, recall)]})

    probes = {r.dims: r.probes for r in drawn.groupBy("dims").applyInPandas(last, "dims int, probes int").collect()}  # a row for each length of vectors
    return {d: replace(m, probes=probes.get(d, 1)) for d, m in models.items()}


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    lists: int | None = None,
    recall: float = 0.99,
    sample: int = 8192,
    flat: int = 1024,
    numbers: int = 1 << 22,
    rows_per_block: int = 4096,
    queries_per_block: int = 1024,
    width: int = 16,
    slack: float = 2.1,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query, by cosine in double precision.

    Every vector goes to the list of its nearest centroid. There are as many lists as the square root of
    the rows (64 at least), or ``lists``; their centroids have ``numbers`` numbers at the most, which bounds what tasks are sent.
    Up to ``flat`` lists are fitted at once on ``sample`` vectors at the most (the documented bound); more of them on two levels,
    the second from some 16 vectors for every list, under each coarse centroid in a task of its own. The number of
    probed lists is fitted on the sample.
    Lists are cut into blocks of about ``rows_per_block`` rows and a list's queries
    into blocks of about ``queries_per_block``; each pair of blocks is scanned on
    its own, so neither a hot list nor a hot query set is gathered in one task, and
    nothing is left out of a list. Lists are probed from the nearest on until both the
    fitted number of lists and k + 1 vectors are reached. Scores of the survivors
    are exact; ties go to the smaller vec_id.

    A query's candidates are all other vec_ids of as many dimensions. Null, empty,
    zero or non-finite vectors and null vec_ids take no part; rows that repeat a
    vec_id are candidates of their own and one query. Fewer candidates than k:
    all of them.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("__query").alias("query"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_valid(F.col("embedding"))).withColumn("dims", F.size("embedding"))
    per_dims = {r.dims: r.n for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors

    models = fit_lists(rows, per_dims, k, recall, sample, lists, flat, numbers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, group in batch.groupby("dims"):
                own = matrix(group["embedding"])
                near = models[dims].assign(unit(own))
                yield pd.DataFrame({"dims": dims, "list": near, "vec_id": group["vec_id"].to_numpy(), "query": group["query"].to_numpy(), "vector": [v.tobytes() for v in own.astype("<f8")]})

    index = materialise(rows.mapInPandas(assign, "dims int, list int, vec_id bigint, query boolean, vector binary"), "index")
    sizes: dict[int, dict[int, int]] = {}
    for r in index.groupBy("dims", "list").agg(F.count("*").alias("n")).collect():  # a row for each list
        sizes.setdefault(r.dims, {})[r.list] = r.n

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, group in batch.groupby("dims"):
                model = models[dims]
                size = np.array([sizes[dims].get(x, 0) for x in range(len(model.centres))])
                order = np.argsort(-(unit(unpack(group["vector"].tolist())) @ model.centres.T), axis=1)
                met = np.cumsum(size[order], axis=1)
                wanted = (np.arange(order.shape[1])[None, :] < model.probes) | (met - size[order] <= k)
                wanted &= size[order] > 0
                at, place = np.nonzero(wanted)
                yield pd.DataFrame({"dims": dims, "list": order[at, place], "query_id": group["vec_id"].to_numpy()[at], "vector": group["vector"].to_numpy()[at]})

    queries = index.where("query").select("dims", "vec_id", "vector").dropDuplicates(["dims", "vec_id"])
    probed = materialise(queries.mapInPandas(probe, "dims int, list int, query_id bigint, vector binary"), "probed")
    asked = probed.groupBy("dims", "list").agg(F.count("*").alias("asked"))
    parts = index.groupBy("dims", "list").agg(F.count("*").alias("rows")).join(asked, ["dims", "list"])
    parts = materialise(parts.select("dims", "list", F.ceil(F.col("rows") / rows_per_block).cast("int").alias("row_blocks"), F.ceil(F.col("asked") / queries_per_block).cast("int").alias("query_blocks")), "parts")
    spread = F.xxhash64("vec_id")
    left = index.join(parts, ["dims", "list"]).withColumn("row_block", F.pmod(spread, F.col("row_blocks")).cast("int"))
    left = left.select("dims", "list", "row_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "vec_id", "vector")
    right = probed.join(parts, ["dims", "list"]).withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int"))
    right = right.select("dims", "list", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"), "query_block", "query_id", "vector")

    def nearest(key: tuple, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(own) and len(asking):
            raw, raw_query = unpack(own["vector"].tolist()), unpack(asking["vector"].tolist())
            turn = rotation(raw.shape[1])
            ids, turned, turned_query = own["vec_id"].to_numpy(), unit(raw) @ turn, unit(raw_query) @ turn
            norms = np.linalg.norm(raw, axis=1)
            for query_id, query, vector in zip(asking["query_id"].to_numpy(), turned_query, raw_query, strict=True):
                places = scan(query, turned, ids, query_id, k, width, slack)
                scores = raw[places] @ vector / (norms[places] * np.linalg.norm(vector))
                best = np.lexsort((ids[places], -scores))[:k]
                out += [(int(query_id), int(ids[places[b]]), float(scores[b])) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    block = ["dims", "list", "row_block", "query_block"]
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(nearest, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
