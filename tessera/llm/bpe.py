"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import small_batches

#: The vocabulary's pre-token pattern (white space as Unicode has it).
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_INF = 1 << 60
#: Bytes of a pre-token after which the transducer's state is remembered.
_STEM = 6


def _byte_letters() -> dict[str, int]:
    """Printable letter of each byte in vocabulary files: itself if visible Latin-1, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """A merge list: tokens, ranks, and which two tokens can stand side by side.

    Merges run in rank order and a token's parts rank before it. So two tokens stay
    apart exactly if no token of the first one's right edge and of the second one's
    left edge merge while both are there: before the first is merged on, and not
    after the second is (the left one of equal pairs merges first). Whether a
    sequence is the encoding of its bytes shows in its neighbouring pairs
    alone; hence the last token of every prefix follows from earlier prefixes.
    """

    def __init__(self, file: str) -> None:
        spec = json.loads(file)
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        as_bytes = {name: bytes(letters[c] for c in name) for name in vocab}
        self.ids = {as_bytes[name]: i for name, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in vocab.items():
            self.bytes_of[i] = as_bytes[name]
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.ranks: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.ranks[a, b] = rank
            made.setdefault(c, (rank, a, b))
        #: Beginnings of tokens; -1 where none ends.
        self.begun: dict[bytes, int] = {}
        for data, i in self.ids.items():
            self.begun[data] = i
            for k in range(1, len(data)):
                self.begun.setdefault(data[:k], -1)
        self.size = [len(x) for x in self.bytes_of]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self._edges = ({}, {})
        self._made = made
        #: What ``apart`` has found, by a << 32 | b; up to ``most`` pairs.
        self.most = 200_000
        self.pairs: dict[int, bool] = {}
        #: Bytes after which no later token can begin before a place: the longest token.
        self.lookahead = max(map(len, self.ids))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens down the right (0) or left (1) edge, each with the rank at which it is merged on."""
        known = self._edges[side].get(token)
        if known is None:
            known, until, t = [], _INF, token
            while True:
                known.append((t, until))
                if t not in self._made:
                    break
                until, a, b = self._made[t]
                t = a if side else b
            self._edges[side][token] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` can be neighbours in an encoding."""
        ranks, right = self.ranks, self._edge(b, 1)
        known = not any((r := ranks.get((x, y))) is not None and r < x_until and r <= y_until for x, x_until in self._edge(a, 0) for y, y_until in right)
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known


class Transducer:
    """Reads bytes, emits token ids once no later byte can change them.

    For every place behind the last emitted token it holds the last token of the
    prefix that ends there. A later token begins at an open place, one from which on
    the bytes read so far begin a token, hence at one of the last ``lookahead``; so
    tokens on which the paths to all open places agree are stable. Memory is
    bounded by the lookahead and the stretch on which paths still differ.
    """

    def __init__(self, table: MergeTable) -> None:
        self.table = table
        self.window = b""
        self.last: list[int] = [-1]
        self.open: list[int] = [0]  # places where a token that goes on may have begun
        self.before = -1  # the last emitted token

    def feed(self, data: bytes) -> list[int]:
        """Ids that have become stable."""
        out: list[int] = []
        step = 4 * self.table.lookahead
        for i in range(0, len(data), step):
            self._read(data[i : i + step])
            out += self._emit({*self.open})
        return out

    def close(self) -> list[int]:
        """The rest; then the transducer is as new."""
        out = self._emit({len(self.window)})
        self.window, self.last, self.open, self.before = b"", [-1], [0], -1
        return out

    def _read(self, data: bytes) -> None:
        begun, pairs, apart = self.table.begun.get, self.table.pairs.get, self.table.apart
        last, open_, window = self.last, self.open, self.window + data
        for end in range(len(last), len(window) + 1):
            found, going = -2, []
            for start in open_:
                token = begun(window[start:end])
                if token is None:
                    continue
                going.append(start)
                if token >= 0 and found < 0:
                    left = last[start] if start else self.before
                    if left >= 0:
                        free = pairs(left << 32 | token)
                        if not (apart(left, token) if free is None else free):
                            continue
                    found = token
            last.append(found)
            if found >= 0:
                going.append(end)
            open_ = going
        self.window, self.open = window, open_

    def _emit(self, ends: set[int]) -> list[int]:
        """Tokens common to the paths that end in ``ends``."""
        size, last = self.table.size, self.last
        while len(ends) > 1:
            far = max(ends)
            ends.discard(far)
            ends.add(far - size[last[far]])
        at = end = ends.pop()
        out = []
        while end:
            out.append(last[end])
            end -= size[last[end]]
        if at:
            self.before, self.window, self.last, self.open = out[0], self.window[at:], [-1, *last[at + 1 :]], [s - at for s in self.open]
        return out[::-1]


class Codec(dict):
    """Encodes and decodes whole texts; as a dict, short pre-tokens to packed ids.

    Pre-tokens are encoded by the transducer. Those of up to ``short`` characters
    are remembered in two generations of ``most`` entries, so memory is bounded.
    """

    def __init__(self, file: str, short: int = 24, most: int = 250_000, chars: int = 1 << 16) -> None:
        super().__init__()
        self.table, self.short, self.most, self.chars = MergeTable(file), short, most, chars
        self.older: dict[str, bytes] = {}
        self.stems: dict[bytes, tuple[tuple[int, ...], list[int]]] = {}
        self.split = regex.compile(PRETOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True))) or r"(?!)")
        self.transducer = Transducer(self.table)

    def __missing__(self, word: str) -> bytes:
        short = len(word) <= self.short
        packed = self.older.get(word) if short else None
        if packed is None:
            reader, data = self.transducer, word.encode("utf-8", "surrogatepass")
            ids = [] if short else reader.feed(data)
            if short:
                self._start(data[:_STEM])
                reader._read(data[_STEM:])
            ids += reader.close()
            packed = b"".join(map(self.table.packed.__getitem__, ids))
        if short:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def _start(self, stem: bytes) -> None:
        """Brings the new transducer behind a pre-token's first bytes; many pre-tokens share these."""
        reader = self.transducer
        known = self.stems.get(stem)
        if known is None:
            reader._read(stem)
            if len(self.stems) >= self.most // 4:
                self.stems.clear()
            self.stems[stem] = (tuple(reader.last), reader.open)
        else:
            reader.window, reader.last, reader.open = stem, [*known[0]], known[1]

    def _plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special tokens, window by window.

        What stands at a window's end may read on behind it and waits for the next
        one: the last pre-token, and an apostrophe before it that may be a
        contraction whose last letter is not in the window. Where nothing else is
        in the window, the window grows.
        """
        at, width, n = 0, self.chars, len(text)
        while at < n:
            words = self.split(text[at : at + width])
            if at + width < n:
                held = 2 if len(words) > 1 and words[-2] == "'" and len(words[-1]) == 1 else 1
                if len(words) == held:
                    width *= 2
                    continue
                at -= sum(map(len, words[-held:]))
                del words[-held:]
            yield b"".join(map(self.__getitem__, words))
            at, width = min(n, at + width), self.chars

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed little-endian ids, piece by piece."""
        at = 0
        for found in self.special.finditer(text):
            yield from self._plain(text[at : found.start()])
            yield self.table.packed[self.table.special[found.group()]]
            at = found.end()
        yield from self._plain(text[at:] if at else text)

    def decode(self, pieces: Iterator[bytes]) -> Iterator[str]:
        """Text of packed ids; a state machine carries unfinished characters from piece to piece."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        known = self.table.bytes_of
        for packed in pieces:
            yield machine.decode(b"".join(map(known.__getitem__, np.frombuffer(packed, "<u4").tolist())))
        yield machine.decode(b"", True)


_CODECS: dict[str, Codec] = {}


def codec_of(name: str, file: str) -> Codec:
    """This process's codec for a vocabulary; tasks that share a worker share it and what it remembers."""
    if name not in _CODECS:
        _CODECS[name] = Codec(file)
    return _CODECS[name]


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every whole text, then decode the ids again.

    ``vocabulary`` is the path of a byte-level BPE file (JSON with vocab and
    merges). Takes doc_id, text; returns doc_id, ids (little-endian unsigned 32-bit
    integers, packed) and decoded. A null text counts as empty; strings of special
    tokens in a text become their ids. One pass, no shuffle; only texts go to
    Python, and a worker keeps its codec from task to task. Repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))  # a vocabulary, never data

    @F.pandas_udf("ids binary, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(vocabulary, file.value)
        for batch in batches:
            ids, decoded = [], []
            for text in batch:
                pieces = list(codec.encode(text or ""))
                ids.append(b"".join(pieces))
                decoded.append("".join(codec.decode(iter(pieces))))
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    return docs.select("doc_id", coded(F.col("text")).alias("coded")).select("doc_id", "coded.ids", "coded.decoded")
