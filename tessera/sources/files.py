"""Sources: manifests, tables, JSON documents, WAV files, and a generated batch."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.contract import RUN_DDL


def read_manifests(spark: SparkSession, path: str, sessions: Sequence[str] = (), players: Sequence[str] = ()) -> DataFrame:
    """Run rows of JSON-lines manifests below <path>/<session>/<player>/.

    Unknown keys are ignored, missing ones null. Blank lines, broken JSON and non-objects are
    dropped; ``rejected_lines`` returns them. The folder names stand in for null session and player ids, and select
    manifests before anything is read.
    """
    pick = lambda names: "{" + ",".join(names) + "}" if names else "*"
    runs = _manifest_lines(spark, f"{path}/{pick(sessions)}/{pick(players)}/*.jsonl").where("_bad is null and value is not null").select("__path", "value.*")
    folder = lambda i: F.regexp_extract("__path", r"/([^/]+)/([^/]+)/[^/]+$", i)
    return runs.withColumns({"session_id": F.coalesce("session_id", folder(1)), "player_id": F.coalesce("player_id", folder(2))}).drop("__path")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Manifest lines that hold no run, with their file."""
    return _manifest_lines(spark, f"{path}/*/*/*.jsonl").where("_bad is not null").select("__path", F.col("_bad").alias("line"))


def _manifest_lines(spark: SparkSession, glob: str) -> DataFrame:
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("__path"), F.trim("value").alias("line")).where("line <> ''")
    parsed = F.when(F.col("line").startswith("{"), F.from_json("line", f"{RUN_DDL}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    met = lines.select("__path", "line", parsed.alias("value"))
    bad = F.col("value").isNull() | F.col("value._corrupt").isNotNull()
    return met.select("__path", F.col("value").dropFields("_corrupt").alias("value"), F.when(bad, F.col("line")).alias("_bad"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S3: a CSV table with a header under a given schema; NaN is read as NaN."""
    return spark.read.schema(schema).csv(path, header=True)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents, one a file; broken ones are absent."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(kind.add("_bad", T.StringType())).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_calibrations(spark: SparkSession, path: str, schema: T.StructType | str, least: int = 4) -> DataFrame:
    """Calibration lines with ``least`` points or more."""
    return spark.read.schema(schema).json(path).where(F.size("points") >= least)


def every_nth(frames: DataFrame, index: str, total: Column, wanted: int) -> DataFrame:
    """Every max(1, total // wanted)-th frame."""
    return frames.where(F.col(index) % F.greatest(F.lit(1), F.floor(total / wanted)) == 0)


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples in [-1, 1] and the rate of a PCM WAV file; None if it cannot be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        kind, scale, zero = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 32768.0, 0.0), 4: ("<i4", 2147483648.0, 0.0)}[width]
        samples = (np.frombuffer(raw, kind).astype(np.float64) - zero) / scale
    return samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def read_wav_windows(spark: SparkSession, path: str, windows: DataFrame, least_s: float = 0.0) -> DataFrame:
    """Samples of each window (event_id, wav_path, onset_s, dur_s) of the files below ``path``.

    A file is read and decoded once for all its windows. Bounds are rounded to samples and
    cut at the file's ends; a missing or broken file or a window shorter than
    ``least_s`` gives null samples. wav_path is matched by its ending.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    asked = windows.select("event_id", F.element_at(F.split("wav_path", "/"), -1).alias("file"), "onset_s", "dur_s")
    per_file = asked.groupBy("file").agg(F.collect_list(F.struct("event_id", "onset_s", "dur_s")).alias("asked"))  # the events of one recording
    met = per_file.join(files, "file", "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, wanted in zip(batch["content"], batch["asked"], strict=True):
                found = decode_wav(content)
                rows = []
                for w in wanted:
                    part = None
                    if found and w["onset_s"] is not None and w["dur_s"] is not None and w["dur_s"] >= least_s:
                        a, b = (int(round(t * found[1])) for t in (w["onset_s"], w["onset_s"] + w["dur_s"]))
                        part = found[0][max(0, a) : max(0, b)].astype(np.float32)
                    rows.append((w["event_id"], found[1] if found else None, part))
                yield pd.DataFrame(rows, columns=["event_id", "rate", "samples"])

    return met.mapInPandas(cut, "event_id string, rate int, samples array<float>")


def demo_runs(players: DataFrame, strings: Sequence[int], frets: Sequence[int], classes: Sequence[str], takes: int) -> DataFrame:
    """A grid of runs for each player (player_id, p) with the pitch that each should sound; a player is by ``p`` steps detuned and louder."""
    grid = players.select("player_id", "p")
    for name, values in (("s_num", strings), ("fret", frets), ("intended_class", classes), ("take", range(takes))):
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    opens = F.element_at(F.create_map(*[F.lit(x) for kv in {6: 40, 5: 45, 4: 50, 3: 55, 2: 59, 1: 64}.items() for x in kv]), F.col("s_num"))
    hz = 440 * F.pow(F.lit(2.0), (opens + F.col("fret") - 69) / 12) * (1 + 0.0008 * F.col("p"))
    return grid.select(F.concat_ws("-", "player_id", "s_num", "fret", "intended_class", "take").alias("run_id"), F.lit("demo").alias("session_id"), "player_id", "s_num", F.array("fret").alias("frets"), "intended_class", F.lit(1).alias("expected_note_count"), hz.alias("hz"), (0.5 + 0.05 * F.col("p")).alias("gain"))
