"""Exact dedup by Patricia tries that own the texts of a length-and-hash partition."""

from __future__ import annotations

import functools
import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import small_batches

#: Fixed by the task's contract: what one space stands for in the text that is compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: A terminal node's content: the smallest identifier (null: none known) and the number of rows.
Entry = tuple[bytes, int | None, int]


class _Node:
    """An edge's bytes, the nodes below by their first byte, and, on a terminal node, its owner."""

    __slots__ = ("kids", "label", "least", "rows", "spool")

    def __init__(self, label: bytes, least: int | None = None, rows: int = 0) -> None:
        self.label, self.least, self.rows = label, least, rows
        self.kids: dict[int, _Node] = {}
        self.spool = None  # a file that took everything below this node, its own text included


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, which differ, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        half = (low + high + 1) // 2
        if label.startswith(key[at + low : at + half], low):
            low = half
        else:
            high = half - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over whole byte strings; terminal nodes keep the smallest identifier and count rows.

    Beyond ``limit`` bytes of labels, subtrees of the root go to files of their own (nameless,
    so a task that ends leaves nothing), the largest first; strings that arrive later below such a
    node are appended there. ``entries`` reads one file after the other into a trie of its own, which may
    spill again: its strings are shorter by the spilled node's label. So memory holds ``limit`` bytes
    and the string at hand, whatever a partition holds.
    """

    def __init__(self, limit: int, prefix: bytes = b"") -> None:
        self.limit, self.prefix, self.held = limit, prefix, 0
        self.root = _Node(b"")

    def insert(self, key: bytes, least: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spool is not None:
                pickle.dump((key[at:], least, rows), node.spool)
                return
            if at == len(key):
                known = node.least if node.rows else None
                node.least = least if known is None else known if least is None else min(known, least)
                node.rows += rows
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], least, rows)
                self.held += len(key) - at + 200  # a node's own size, about
                if self.held > self.limit:
                    self._spill()
                return
            if not key.startswith(kid.label, at):
                same = _shared(kid.label, key, at)
                self.held += 200
                upper = _Node(kid.label[:same])
                kid.label = kid.label[same:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = upper
            node, at = kid, at + len(kid.label)

    def _spill(self) -> None:
        """Move the root's subtrees to files, the largest first, until half the limit is free; a string that is alone stays, whatever its length."""
        weights = [(sum(len(n.label) + 200 for n in _below(kid)), first) for first, kid in self.root.kids.items() if kid.spool is None]
        for weight, first in sorted(weights, reverse=True):
            if self.held <= self.limit // 2 or (len(weights) == 1 and not self.root.kids[first].kids):
                break
            kid = self.root.kids[first]
            label = kid.label if kid.kids else kid.label[:1]  # a whole text goes with the rest
            spool = tempfile.TemporaryFile()  # noqa: SIM115 - closed when its strings have been read
            for key, least, rows in _terminals(kid, kid.label[len(label) :]):
                pickle.dump((key, least, rows), spool)
            for node in _below(kid):  # files below keep what they hold: they are copied into the new one
                if node.spool is not None:
                    node.spool.close()
            self.root.kids[first] = emptied = _Node(label)
            emptied.spool = spool
            self.held -= weight - len(label) - 200

    def entries(self) -> Iterator[Entry]:
        """Every distinct string with its smallest identifier and row count; the trie is used up."""
        spilled = []
        for node, path in _walk(self.root, b""):
            if node.spool is not None:
                spilled.append((node.spool, path))
            elif node.rows:
                yield self.prefix + path, node.least, node.rows
        self.root = _Node(b"")
        for spool, path in spilled:
            part = PatriciaTrie(self.limit, self.prefix + path)
            for key, least, rows in _records(spool):
                part.insert(key, least, rows)
            spool.close()
            yield from part.entries()


def _walk(node: _Node, path: bytes) -> Iterator[tuple[_Node, bytes]]:
    """Nodes at and below ``node`` with the string that leads to each (``path`` leads to the first), without recursion."""
    todo = [(node, path)]
    while todo:
        node, path = todo.pop()
        yield node, path
        todo += [(kid, path + kid.label) for kid in node.kids.values()]


def _below(node: _Node) -> Iterator[_Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += node.kids.values()


def _terminals(node: _Node, path: bytes) -> Iterator[Entry]:
    for found, at in _walk(node, path):
        if found.spool is not None:
            yield from ((at + key, least, rows) for key, least, rows in _records(found.spool))
        elif found.rows:
            yield at, found.least, found.rows


def _records(spool) -> Iterator[Entry]:
    spool.seek(0)
    while True:
        try:
            yield pickle.load(spool)  # noqa: S301 - this task's own file
        except EOFError:
            return


def _batches(entries: Iterable[Entry], make, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``size`` bytes of strings at the most."""
    rows, held = [], 0
    for entry in entries:
        rows.append(entry)
        held += len(entry[0]) + 50
        if held > size:
            yield make(rows)
            rows, held = [], 0
    if rows:
        yield make(rows)


def _strings(rows: list[Entry]) -> pa.RecordBatch:
    keys, least, counts = zip(*rows, strict=True)
    return pa.record_batch([pa.array(keys, pa.binary()), pa.array(least, pa.int64()), pa.array(counts, pa.int64())], ["key", "least", "rows"])


def _owners(rows: list[Entry]) -> pa.RecordBatch:
    keys, least, counts = zip(*rows, strict=True)
    names = [hashlib.sha256(k).hexdigest() for k in keys]
    return pa.record_batch([pa.array(names, pa.string()), pa.array(least, pa.int64()), pa.array(counts, pa.int64())], ["owner", "keep_id", "group_size"])


def _inserted(batches: Iterator[pa.RecordBatch], limit: int, owners: bool) -> Iterator[pa.RecordBatch]:
    """Insert a partition's strings: before the shuffle tries are emptied when they are full, after it they spill."""
    trie = PatriciaTrie(limit if owners else limit * 2)
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            trie.insert(*row)
        if not owners and trie.held > limit:
            yield from _batches(trie.entries(), _strings)
            trie = PatriciaTrie(limit * 2)
    yield from _batches(trie.entries(), _owners if owners else _strings)


def exact_duplicates(docs: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs`` (doc_id bigint, text).

    Texts are equal when their bytes are, after each run of blanks has become one space; null
    counts as empty. Each input partition inserts its texts into a trie, so copies that lie
    together leave it as one string with the smallest doc_id and a count: a group of a third of all rows sends one
    string a partition. Strings are dealt by length and content hash; each partition's trie
    compares whole byte strings, so two texts that share a hash stay two. The owners (terminal nodes) of two rows
    or more are then joined to the documents under the digest of the string that leads to them; a text without a copy is its own owner. Tries spill by subtree beyond ``limit`` bytes.

    Null doc_ids are larger than all others; a group of nothing else has keep_id null and keeps its rows.
    ``kept`` is doc_id = keep_id, so rows that repeat both text and doc_id, which are one document, share a fate.
    Other columns of ``docs`` are ignored. Empty in, empty out.
    """
    small_batches(docs.sparkSession)
    key = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ").cast("binary")
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("bigint").alias("least"))
    strings = rows.mapInArrow(functools.partial(_inserted, limit=limit, owners=False), "key binary, least bigint, rows bigint")
    dealt = strings.withColumn("length", F.octet_length("key")).withColumn("hash", F.xxhash64("key")).repartition("length", "hash")
    owners = dealt.select("key", "least", "rows").mapInArrow(functools.partial(_inserted, limit=limit, owners=True), "owner string, keep_id bigint, group_size bigint")
    shared = owners.where("group_size > 1")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(key, 256).alias("text_sha256"))
    met = named.join(shared, F.col("text_sha256") == F.col("owner"), "left")
    keep = F.when(F.col("owner").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return met.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
