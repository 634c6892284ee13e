"""Frames and uploads that arrive over a network: an append-only log a session, read as a stream with offsets and admission."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: A record: length of the rest, kind, milliseconds, then the payload.
_HEAD = struct.Struct(">IBq")
#: What a client sends: a binary frame, a text (which frame readers ignore), a media file, a manifest row, a keyframe.
KINDS = {"frame": 0, "text": 1, "media": 2, "manifest": 3, "keyframe": 4}
_NAMES = {v: k for k, v in KINDS.items()}
SCHEMA = "session string, at bigint, kind string, ts_ms bigint, payload binary"


def append(folder: str, session: str, records: Iterable[tuple[str, int, bytes]]) -> None:
    """What a server's handler does with (kind, ts_ms, payload): one write to the session's log, so a reader sees whole records or a cut last one."""
    os.makedirs(folder, exist_ok=True)
    data = b"".join(_HEAD.pack(_HEAD.size - 4 + len(p), KINDS[kind], ts) + p for kind, ts, p in records)
    with open(os.path.join(folder, f"{session}.log"), "ab") as log:
        log.write(data)


def _records(path: str, start: int, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
    with open(path, "rb") as log:
        log.seek(start)
        while start < stop:
            length, kind, ts = _HEAD.unpack(log.read(_HEAD.size))
            yield start, kind, ts, log.read(length - (_HEAD.size - 4))
            start += 4 + length


def _admitted(path: str, start: int, most: int) -> int:
    """The offset after at most ``most`` whole records from ``start``; only heads are read."""
    size = os.path.getsize(path)
    with open(path, "rb") as log:
        for _ in range(most):
            log.seek(start)
            head = log.read(4)
            if len(head) < 4 or (after := start + 4 + int.from_bytes(head, "big")) > size:
                break
            start = after
    return start


@dataclass
class _Range(InputPartition):
    session: str
    start: int
    stop: int


class FrameLogReader(DataSourceStreamReader):
    """Offsets are bytes of each session's log; a batch takes ``most`` records a session, each session as a task of its own.

    What has been offered is written to ``progress`` before Spark hears of it, so after a restart no
    offer lies behind the offset that Spark's checkpoint holds: nothing is read twice or passed over. What was
    offered before a crash and not written down by Spark makes the next batch so much larger.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.progress = options["path"], options["progress"]
        self.most, self.kinds = int(options.get("most", "1")), [k for k in options.get("kinds", "").split(",") if k]
        self.offered: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.offered is None:
            self.offered = {}
            if os.path.exists(self.progress):
                with open(self.progress) as f:
                    self.offered = json.load(f)
        logs = sorted(f[:-4] for f in os.listdir(self.folder) if f.endswith(".log")) if os.path.isdir(self.folder) else []
        after = {s: _admitted(self._log(s), self.offered.get(s, 0), self.most) for s in logs}
        if after != self.offered:
            os.makedirs(os.path.dirname(self.progress) or ".", exist_ok=True)
            fresh = f"{self.progress}.{uuid.uuid4().hex}"
            with open(fresh, "w") as f:
                json.dump(after, f)
            os.replace(fresh, self.progress)
            self.offered = after
        return dict(self.offered)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(s, start.get(s, 0), stop) for s, stop in sorted(end.items()) if stop > start.get(s, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for at, kind, ts, payload in _records(self._log(partition.session), partition.start, partition.stop):
            name = _NAMES.get(kind)
            if not self.kinds or name in self.kinds:
                yield partition.session, at, name, ts, payload

    def _log(self, session: str) -> str:
        return os.path.join(self.folder, f"{session}.log")


class FrameLog(DataSource):
    """Options: path (folder of logs, on a disk that driver and executors share), progress (a file beside the query's checkpoint), most, kinds."""

    @classmethod
    def name(cls) -> str:
        return "tessera_frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameLogReader:  # noqa: ARG002
        return FrameLogReader(self.options)


def stream_records(spark: SparkSession, folder: str, progress: str, most: int = 1, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(session, at, kind, ts_ms, payload) as a stream; ``most`` records a session are under way at a time, kinds none: all."""
    spark.dataSource.register(FrameLog)
    return spark.readStream.format("tessera_frames").options(path=folder, progress=progress, most=str(most), kinds=",".join(kinds)).load()


def manifest_lines(records: DataFrame, schema: str) -> DataFrame:
    """The manifest rows among records, parsed; what is no JSON is null in every field."""
    text = F.decode("payload", "UTF-8")
    return records.where(F.col("kind") == "manifest").select("session", "at", "ts_ms", F.from_json(text, schema).alias("row"))
