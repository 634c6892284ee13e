"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import deal_pairs, smallest_linked, whole_groups
from tessera.plans import connected_components, materialise, small_batches

#: Slots of a signature; a power of two, so that an odd step visits every slot once.
SLOTS = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, ``n`` of each."""
    steps = np.full((2, n), _BASE, np.uint64)
    steps[1] = pow(_BASE, -1, 1 << 64)
    steps[:, 0] = 1
    return tuple(np.multiply.accumulate(steps, axis=1))


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word of UTF-8 ``data``, A-Z as a-z; words lie between [\\x20\\x09-\\x0D].

    A word's polynomial is the difference of two prefix sums, shifted to the
    word's own start, so equal words get equal hashes wherever they stand.
    """
    raw = np.frombuffer(data, np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = max(_CHUNK, 1 << (len(raw) - 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * inverse[starts]
    return _mix(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's ``words``-word shingles.

    Fewer words make one shingle; none make an empty set. Long texts are hashed in
    pieces cut at white space.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(word_hashes(data[at:end]))
        at = end
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    code = np.full(n, k, np.uint64)
    for i in range(k):
        code = _mix(code * np.uint64(3) + h[i : i + n])
    return np.unique(code)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A signature of SLOTS numbers for each non-empty set.

    Every element ranks the slots by a permutation of its own (a start and an odd
    step) and offers rank + fraction to each. Ranks are dealt level by level: what
    level j offers lies in [j, j + 1), so a filled slot never changes on a later level
    and a set is done as soon as all its slots are filled. An element's offers to
    different slots differ in rank, which lowers the variance against independent hashes.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = _mix(np.concatenate(sets) + np.uint64(0x5851F42D4C957F2D))
    out = np.full((len(sets), SLOTS), _EMPTY)
    flat = out.reshape(-1)
    start = (element & np.uint64(SLOTS - 1)).astype(np.int64)
    step = ((element >> np.uint64(16)) & np.uint64(SLOTS - 1)).astype(np.int64) | 1
    for level in range(SLOTS):
        slot = (start + level * step) & (SLOTS - 1)
        offer = (_mix(element + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)) | np.uint64(level << 52)
        np.minimum.at(flat, owner * SLOTS + slot, offer)
        if level < 8 or level % 8 == 7:
            open_ = (out == _EMPTY).any(axis=1)[owner]
            if not open_.any():
                break
            owner, element, start, step = owner[open_], element[open_], start[open_], step[open_]
    return out


def band_rows(threshold: float, missed: float = 1e-5) -> int:
    """Rows of a band: the most that miss a pair at the threshold with a chance of ``missed`` at most."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (SLOTS // r) <= missed)


def _signatures(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (128 bits of the whole set), bands, sketch (a bit for each slot)."""
    bands = SLOTS // rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = _mix(np.arange(bands, dtype=np.uint64) + np.uint64(977))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingles(t, words) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                band: list = [[]] * len(sets)
                sketch: list = [[]] * len(sets)
                keys = np.zeros((len(sets), 2), np.uint64)
                if full:
                    signature = super_minhash([sets[i] for i in full])
                    codes = _mix((_mix(signature[:, : bands * rows]).reshape(-1, bands, rows) * weight).sum(axis=2, dtype=np.uint64) + salt)
                    bits = np.packbits((_mix(signature) & np.uint64(1)).astype(np.uint8), axis=1).view("<u8")
                    for j, i in enumerate(full):
                        band[i], sketch[i] = codes[j].view(np.int64), bits[j].view(np.int64)
                        keys[i] = sets[i].sum(dtype=np.uint64), _mix(sets[i]).sum(dtype=np.uint64)
                signed = keys.view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets], "k1": signed[:, 0], "k2": signed[:, 1], "bands": band, "sketch": sketch})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the full set of shingle hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "set": [shingles(t, words).view(np.int64) for t in part["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, set array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _open_pairs(batch: pd.DataFrame, a: int, b: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the group at a..b: rows, columns, and which of their pairs may be a link between different components.

    The largest component's own pairs are never formed. Pairs of sizes or sketches that differ too much are out.
    """
    none = np.zeros(0, np.int64)
    n, c, o = (batch[k].to_numpy()[a:b] for k in ("n", "component", "own"))
    names, counts = np.unique(c, return_counts=True)
    if len(names) < 2:
        return none, none, np.zeros((0, 0), bool)
    rows = np.flatnonzero(c != names[counts.argmax()])
    open_ = (c[rows, None] != c[None, :]) & (np.maximum(n[rows, None], n[None, :]) * percent <= np.minimum(n[rows, None], n[None, :]) * 100)
    if batch["low"].iat[a] != batch["high"].iat[a]:
        open_ &= o[rows, None] != o[None, :]
    sketch = np.stack(batch["sketch"].iloc[a:b].to_numpy()).view(np.uint64)
    apart = sum(np.bitwise_count(sketch[rows, None, k] ^ sketch[None, :, k]).astype(np.int32) for k in range(sketch.shape[1]))
    open_ &= apart <= int(SLOTS * (0.5 * (1 - percent / 100) + 0.13))
    some, columns = open_.any(axis=1), np.flatnonzero(open_.any(axis=0))
    return rows[some], columns, open_[some][:, columns]


def _first_met(batch: pd.DataFrame, a: int, b: int, rows: np.ndarray, columns: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the open pairs of a bucket those that do not share the bucket of an earlier band, where they meet as well."""
    if not len(rows):
        return rows, columns, open_
    bands = np.stack(batch["bands"].iloc[a:b].to_numpy())
    band = int(np.flatnonzero(bands[rows[0]] == batch["bucket"].iat[a])[0])
    for k in range(band):
        open_ = open_ & (bands[rows, k][:, None] != bands[columns, k][None, :])
    return rows, columns, open_


def _linked_across(batch: pd.DataFrame, starts: np.ndarray, percent: int) -> pd.DataFrame:
    """Links between different components in the groups between ``starts``: each linked member and the smallest one it reaches.

    Sizes of intersections come from products of 0/1 matrices, taken over a stretch of the shingles at a time.
    """
    rep, size, held = (batch[c].to_numpy() for c in ("rep", "n", "set"))
    ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(starts[:-1], starts[1:]):
        rows, columns, open_ = _open_pairs(batch, a, b, percent)
        if not len(rows):
            continue
        known = np.unique(np.concatenate([held[a + i] for i in rows]))
        both = np.zeros((len(rows), len(columns)), np.float32)
        for at in range(0, len(known), 4096):
            part = known[at : at + 4096]
            both += _incidence([held[a + i] for i in rows], part) @ _incidence([held[a + j] for j in columns], part).T
        n = size[a:b]
        linked = open_ & (100 * both >= percent * (n[rows, None] + n[None, columns] - both))
        near = np.zeros((b - a, b - a), bool)
        near[np.ix_(rows, columns)] = linked
        near |= near.T
        some = np.flatnonzero(near.any(axis=1))
        ends_a.append(rep[a:b][some])
        ends_b.append(smallest_linked(rep[a:b], near)[some])
    return pd.DataFrame({"a": np.concatenate(ends_a), "b": np.concatenate(ends_b)})


def _incidence(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """Row i has a 1 at each of the sorted ``part`` that sets[i] (in any order) has."""
    flat = np.concatenate(sets)
    at = np.searchsorted(part, flat)
    at[at == len(part)] = 0
    there = part[at] == flat
    out = np.zeros((len(sets), len(part)), np.float32)
    out[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[there], at[there]] = 1
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked when the Jaccard similarity of their whole sets of
    ``words``-word shingles is ``percent`` / 100 or more; component_id is the smallest
    doc_id reachable by links, kept says that the document is that one.

    Equal sets fold into a class first. Classes that share a band are candidates.
    Each member of a bucket is held against the bucket's smallest class and against the one
    that meets most others in all its buckets: a number of pairs linear in the
    members, which joins the bulk of a large group. Where a bucket still has several
    components, the pairs between different components follow, in the first bucket that
    they share, block against block (``block`` rows), unless their one-bit sketches (SLOTS bits) differ so much that a
    link is out of the question; a block pair returns links only. Every link rests on full sets. No pair in a
    bucket is passed over unless its ends are in one component already. Bands are chosen
    to miss a pair at the threshold with a chance of 1e-5 at most.

    Null, empty or blank text: an empty set, linked with nothing. Rows that share a
    doc_id share a component. A null doc_id takes no part: component_id null, kept true.
    """
    small_batches(docs.sparkSession)
    rows = band_rows(percent / 100)
    signatures = materialise(_signatures(docs, words, rows), "signatures")
    keys = ["n_shingles", "k1", "k2"]
    classes = materialise(signatures.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    heads = signatures.join(classes.select(*keys, "rep"), keys).where("doc_id = rep").dropDuplicates([*keys, "rep"])
    heads = materialise(heads.select("rep", F.col("n_shingles").alias("n"), "sketch", "bands"), "heads")
    banded = heads.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    members = materialise(banded.join(shared, "bucket"), "members")
    # the class that meets most others in its buckets stands in the middle of its group
    degree = members.groupBy("rep").agg(F.sum("in_bucket").alias("degree"))
    ranked = members.select("bucket", "rep").join(degree, "rep")
    hub = ranked.groupBy("bucket").agg(F.min("rep").alias("least"), F.max(F.struct("degree", "rep"))["rep"].alias("hub"))
    members = members.join(hub, "bucket").join(heads.drop("bands"), "rep")
    members = materialise(members.select("bucket", "rep", "least", "hub", "n", "sketch"), "members")

    sizes = members.select(F.col("rep").alias("c"), F.col("n").alias("n_c")).distinct()
    fit = F.greatest("n", "n_c") * percent <= F.least("n", "n_c") * 100
    hubs = members.select("rep", "n", F.explode(F.array("least", "hub")).alias("c")).where("rep <> c").distinct()
    star = hubs.join(sizes, "c").where(fit).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    ids = docs.select("doc_id", "text").where("doc_id is not null")
    sets = materialise(_sets(ids.join(materialise(wanted, "wanted"), "doc_id", "left_semi"), words), "sets")
    links = materialise(_confirmed(star, sets, percent), "links")
    parts = connected_components(links)

    # pairs of one bucket that are not in one component yet
    def open_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in whole_groups(batches, ["bucket", "low", "high"]):
            met = [np.zeros(0, np.int64)]
            for a, b in zip(starts[:-1], starts[1:]):
                rows, columns, open_ = _first_met(batch, a, b, *_open_pairs(batch, a, b, percent))
                met += [a + rows[open_.any(axis=1)], a + columns[open_.any(axis=0)]]
            yield batch.iloc[np.unique(np.concatenate(met))][["bucket", "rep", "n", "component", "sketch"]]

    placed = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialise(placed.select("bucket", "rep", "n", "sketch", "component"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    left = placed.join(materialise(mixed, "mixed"), "bucket", "left_semi")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, starts in whole_groups(batches, ["bucket", "low", "high"]):
            yield _linked_across(batch, starts, percent)

    spread = F.xxhash64("rep")
    asked = deal_pairs(left.join(heads.select("rep", "bands"), "rep"), ["bucket"], spread, block).mapInPandas(open_rows, "bucket bigint, rep bigint, n bigint, component bigint, sketch array<bigint>")
    asked = materialise(asked.dropDuplicates(["bucket", "rep"]), "asked")
    dealt = deal_pairs(asked.join(sets.withColumnRenamed("doc_id", "rep"), "rep"), ["bucket"], spread, block)
    more = materialise(dealt.mapInPandas(across, "a bigint, b bigint").distinct(), "links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    of_class = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*keys, F.coalesce("component", "rep").alias("component_id"))
    of_class = materialise(of_class, "components")
    known = signatures.select("doc_id", *keys).join(of_class, keys, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    twice = known.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return twice.unionByName(nameless)
