"""Periodic runs of words by linear tandem-repeat search: LZ blocks, suffix tree, suffix-link walks."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import small_batches

#: A run: first word, number of words, smallest period.
Run = tuple[int, int, int]


class _Ranks:
    """Names of the substrings of length 2^j from every position: equal names, equal substrings.

    The last symbol must occur once. ``order`` sorts the suffixes; common extensions of many pairs are
    taken at once, from the longest power of two down.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n, names = len(symbols), np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names = [names]
        while names.max() < n - 1:
            step = 1 << (len(self.names) - 1)
            after = np.zeros(n, np.int64)
            after[:-step] = names[step:] + 1
            names = np.unique(names * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.names.append(names)
        self.order = np.empty(n, np.int64)
        self.order[names] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from i and j (unequal) onwards."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            step = (self.names[level][i] == self.names[level][j]).astype(np.int64) << level
            i, j, found = i + step, j + step, found + step
        return found

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree up to and with i and j (unequal; -1: none)."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            back = (1 << level) - 1
            far = np.minimum(i, j) >= back
            step = (far & (self.names[level][np.maximum(i - back, 0)] == self.names[level][np.maximum(j - back, 0)])).astype(np.int64) << level
            i, j, found = i - step, j - step, found + step
        return found


class _SuffixTree:
    """Suffix tree over ``symbols``: leaves are positions, inner nodes follow from n; the root is n.

    ``least`` is the smallest leaf below a node, ``first`` and ``last`` bound its leaves in suffix order.
    """

    def __init__(self, symbols: list[int], ranks: _Ranks) -> None:
        n = self.root = len(symbols)
        order = ranks.order.tolist()
        common = [0, *ranks.forward(ranks.order[:-1], ranks.order[1:]).tolist()]
        self.symbols, self.order = symbols, ranks.order
        parent, depth = [n] * n, [n - i for i in range(n)]
        first, last, least = [0] * n, [0] * n, list(range(n))
        for at, leaf in enumerate(order):
            first[leaf], last[leaf] = at, at + 1
        parent.append(n), depth.append(0), first.append(0), last.append(n), least.append(0)
        open_ = [n]
        for at in range(1, n + 1):
            node, bound = order[at - 1], common[at] if at < n else 0
            while depth[open_[-1]] > bound:
                up = open_.pop()
                parent[node] = up
                if least[node] < least[up]:
                    least[up] = least[node]
                last[up] = at
                node = up
            up = open_[-1]
            if depth[up] < bound:
                parent.append(n), depth.append(bound), first.append(first[node]), last.append(at), least.append(least[node])
                up = len(parent) - 1
                open_.append(up)
            elif least[node] < least[up]:
                least[up] = least[node]
            parent[node] = up
        self.parent, self.depth, self.least, self.first, self.last = parent, depth, least, first, last
        self.kids = {(up, symbols[least[v] + depth[up]]): v for v, up in enumerate(parent) if v != n}
        self.link = {n: n}
        for v in sorted(range(n + 1, len(parent)), key=depth.__getitem__):
            up = parent[v]
            self.link[v] = self.down(self.link[up], least[v] + 1, depth[v] - 1)

    def down(self, node: int, start: int, length: int) -> int:
        """The node that ends the edge on which the substring (start, length) ends, from an ancestor of it."""
        while self.depth[node] < length:
            node = self.kids[node, self.symbols[start + self.depth[node]]]
        return node

    def blocks(self) -> list[tuple[int, int]]:
        """LZ blocks [from, to): the longest that starts earlier too, or one symbol; the final symbol has none."""
        known = [0] * self.root
        for v, up in enumerate(self.parent):
            if self.least[v] != self.least[up]:
                known[self.least[v]] = self.depth[up]
        found, at = [], 0
        while at < self.root - 1:
            found.append((at, at + max(known[at], 1)))
            at = found[-1][1]
        return found


def _covering(blocks: list[tuple[int, int]], ranks: _Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of squares that cover the leftmost occurrence of every square.

    Such a square has its centre in a block and leaves the block, to the right or to the left; for each
    half length one common extension to each side of the block's border decides.
    """
    low, high = np.array(blocks).T
    size = high - low
    after = np.append(size[1:], 0)
    end = blocks[-1][1]

    def halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(counts)), counts)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    at, half = halves(size)  # over the right border
    border, other = high[at], high[at] - half
    ahead, back = ranks.forward(border, other), ranks.backward(border - 1, other - 1)
    good = (ahead + back >= half) & (ahead > 0)
    starts, lengths = [np.maximum(other - back, other - half + 1)[good]], [half[good]]
    at, half = halves(np.minimum(size + after, end - low))  # over the left border
    border, other = low[at], low[at] + half
    ahead, back = ranks.forward(border, other), ranks.backward(border - 1, other - 1)
    start = np.maximum(border - back, border - half + 1)
    good = (ahead + back >= half) & (ahead > 0) & (back > 0) & (start + half <= high[at])
    return np.concatenate([*starts, start[good]]), np.concatenate([*lengths, half[good]])


def _vocabulary(tree: _SuffixTree, starts: np.ndarray, halves: np.ndarray) -> set[tuple[int, int]]:
    """Every distinct square as (node below whose edge it ends, half length).

    Squares at the leftmost occurrence of their string are placed by climbing from the leaf, each
    leaf only as far as it is the smallest below. From each, suffix links lead to the next rotation for
    as long as the text has it and no earlier walk has been there.
    """
    parent, depth, least, symbols = tree.parent, tree.depth, tree.least, tree.symbols
    marks: set[tuple[int, int]] = set()
    node = leaf = -1
    for at in np.lexsort((-halves, starts)).tolist():
        start, half = int(starts[at]), int(halves[at])
        if start != leaf:
            node = leaf = start
        while depth[parent[node]] >= 2 * half and least[parent[node]] == start:
            node = parent[node]
        if depth[parent[node]] < 2 * half:
            marks.add((node, half))
    for node, half in list(marks):
        while True:
            start = least[node]
            node = tree.down(tree.link[parent[node]], start + 1, 2 * half - 1)
            if depth[node] > 2 * half - 1:  # inside an edge: one way on
                if symbols[least[node] + 2 * half - 1] != symbols[start]:
                    break
            elif (node := tree.kids.get((node, symbols[start]), -1)) < 0:
                break
            if (node, half) in marks:
                break
            marks.add((node, half))
    return marks


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def _primitive(starts: np.ndarray, halves: np.ndarray, ranks: _Ranks) -> np.ndarray:
    """Whether the half of each square (start, half) is no repetition itself."""
    primes = {h: _primes(h) for h in np.unique(halves).tolist()}
    pairs = [(k, h // p) for k, h in enumerate(halves.tolist()) for p in primes[h]]
    single = np.ones(len(starts), bool)
    if pairs:
        at, step = np.array(pairs).T
        single[at[ranks.forward(starts[at], starts[at] + step) >= 2 * halves[at] - step]] = False
    return single


def squares(symbols: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, half lengths) of all squares of primitive halves, sorted by half length, then start."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64), np.max(symbols) + 1)
    ranks = _Ranks(text)
    tree = _SuffixTree(text.tolist(), ranks)
    marks = sorted(_vocabulary(tree, *_covering(tree.blocks(), ranks)))
    if not marks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, half = np.array(marks).T
    good = _primitive(np.array(tree.least)[node], half, ranks)
    node, half = node[good], half[good]
    first, last = np.array(tree.first)[node], np.array(tree.last)[node]
    halves = np.repeat(half, last - first)
    at = np.arange(len(halves)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
    starts = tree.order[at]
    order = np.lexsort((starts, halves))
    return starts[order], halves[order]


def runs_of(symbols: Sequence[int], least: int, times: int) -> list[Run]:
    """Maximal runs of at least ``least`` symbols and ``times`` periods (2 or more), by start, then period: squares of one half length at neighbouring starts are one run."""
    starts, halves = squares(symbols)
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(halves) != 0)) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    period = halves[low]
    length = starts[high] - starts[low] + 2 * period
    good = length >= np.maximum(least, times * period)
    return sorted(zip(starts[low][good].tolist(), length[good].tolist(), period[good].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def _recurs(symbols: np.ndarray, width: int) -> bool:
    """Whether some ``width`` (a power of two) neighbouring symbols stand elsewhere too; a hash may say so wrongly, but not the reverse."""
    value, step = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while step < width and len(value) > step:
        value = (value[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step)) + value[step:]
        value ^= value >> np.uint64(29)
        step *= 2
    return len(symbols) > width and len(np.unique(value)) < len(value)


def word_runs(words: list[bytes], least: int = 24, times: int = 3) -> list[Run]:
    """Runs of ``words``. A run of period q repeats length - q words q further on, so it makes an LZ block of as many at the
    least. Where no stretch that long recurs there is none, and the tree isn't built."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    symbols = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    overlap = min(max(least, times * q) - q for q in range(1, least + 1))
    if not _recurs(symbols, 1 << (overlap.bit_length() - 1)):
        return []
    return runs_of(symbols, least, times)


def _found(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        counts, runs, texts = [], [], []
        for text in batch.column(1).to_pylist():
            words = (text or b"").split()
            found = word_runs(words, least, times)
            kept = np.ones(len(words), bool)
            for start, length, period in found:
                kept[start + period : start + length] = False
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(b" ".join(words if not found else [w for w, k in zip(words, kept.tolist(), strict=True) if k]))
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, run), pa.array(texts, pa.binary())], ["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for each row of ``docs`` (doc_id, text).

    Words are what lies between blanks (space, \\t to \\r), numbered from 0. A run is a stretch with smallest period q of
    max(``least``, ``times`` q) words or more (``times`` 2 or more) that neither neighbour extends; runs are sorted by
    start, then period. ``collapsed`` is UTF-8 text as binary: the words outside of every run's later periods, joined by a space.

    A document is one row of one task, without a shuffle; a text's tree takes some hundred bytes a
    word while it is at work, and texts in which nothing long enough recurs need none. Null and empty texts have no
    words. Repeated rows and null doc_ids are rows like others; other columns are ignored. Empty in, empty out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    found = rows.mapInArrow(functools.partial(_found, least=least, times=times), f"row struct<doc_id: {kind}>, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return found.select("row.doc_id", "n_words", "runs", "collapsed")
