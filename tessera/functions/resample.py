"""Rational resampling of sample streams, chunk by chunk, and the containers that audio comes in."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import small_batches

#: Fixed value of the data format: every recording is brought to this rate before features are taken.
CANONICAL_RATE = 48_000


@functools.cache
def low_pass(up: int, down: int, crossings: int = 24, beta: float = 9.0) -> np.ndarray:
    """A Kaiser-windowed sinc at ``up`` times the input's rate; it passes 0.92 of the lower of both half rates and gains ``up``."""
    wide = max(up, down)
    half = crossings * wide
    t = np.arange(-half, half + 1)
    taps = np.sinc(0.92 * t / wide) * np.kaiser(len(t), beta)
    return up * taps / taps.sum()


def reach(up: int, down: int) -> int:
    """Input samples on each side that an output sample depends on."""
    return (len(low_pass(up, down)) // 2) // up + 1


def resampled(x: np.ndarray, up: int, down: int, first: int, start: int, stop: int) -> np.ndarray:
    """Output samples ``start`` to ``stop`` of a stream whose samples from ``first`` on are ``x``; around them is silence.

    Output n stands at input position n * down / up; each of the ``up`` phases is a short filter of its own, so
    the zeros of the stretched signal are never multiplied.
    """
    phases = _phases(up, down)
    half, width = len(low_pass(up, down)) // 2, phases.shape[1]
    at = np.arange(start, stop, dtype=np.int64) * down
    if not len(x) or not len(at):
        return np.zeros(len(at))
    low = -((half - at) // up)  # the first input whose tap is not before the filter
    # silence around the samples, as far as the outputs reach
    head, tail = max(0, first - int(low[0])), max(0, int(low[-1]) + width - first - len(x))
    padded = np.concatenate([np.zeros(head), x, np.zeros(tail)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)[low - (first - head)]
    return np.einsum("ij,ij->i", windows, phases[at % up])


@functools.cache
def _phases(up: int, down: int) -> np.ndarray:
    """The filter of each of the ``up`` places of an output between two inputs (up x width)."""
    taps = low_pass(up, down)
    half = len(taps) // 2
    at = np.arange(up)
    tap = at[:, None] - (-((half - at) // up)[:, None] + np.arange(2 * (half // up) + 2)) * up + half
    return np.where((tap >= 0) & (tap < len(taps)), taps[np.clip(tap, 0, len(taps) - 1)], 0.0)


def _outputs(at: int, up: int, down: int) -> int:
    """How many outputs stand before input position ``at``."""
    return -(-at * up // down)


def _whole_runs(batches: Iterator[pa.RecordBatch], target: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs cut and filtered chunk by chunk, a record batch a run; a chunk sees as much of the run around it as the filter reaches."""
    for batch in batches:
        names, rates = batch.column(0), batch.column(1).to_pylist()
        for i, (r, x) in enumerate(zip(rates, batch.column(2).to_numpy(zero_copy_only=False), strict=True)):
            g = gcd(r, target)
            up, down = target // g, r // g
            far, cuts = reach(up, down), range(0, len(x), size)
            ends = [_outputs(min(at, len(x)), up, down) for at in (*cuts, len(x))]
            made = [resampled(np.nan_to_num(x[max(0, at - far) : at + size + far].astype(np.float64)), up, down, max(0, at - far), *ends[k : k + 2]).astype(np.float32) for k, at in enumerate(cuts)]
            yield pa.record_batch([names.take(pa.array([i] * len(made), pa.int32())), pa.array(range(len(made)), pa.int32()), pa.array([target] * len(made), pa.int32()), pa.array(ends[:-1], pa.int64()), pa.array(made, pa.list_(pa.float32()))], ["run", "chunk", "rate", "first", "samples"])


def _chunks(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rate, first = (c.to_pylist() for c in batch.columns[1:3])
        before, own, after = (c.to_numpy(zero_copy_only=False) for c in batch.columns[3:])  # an array a row, None for null
        made, starts = [], []
        for r, f, a, b, c in zip(rate, first, before, own, after, strict=True):
            g = gcd(r, target)
            up, down = target // g, r // g
            a, b, c = (np.nan_to_num(np.asarray([] if part is None else part, np.float64)) for part in (a, b, c))
            start, stop = _outputs(f, up, down), _outputs(f + len(b), up, down)
            made.append(resampled(np.concatenate([a, b, c]), up, down, f - len(a), start, stop).astype(np.float32))
            starts.append(start)
        yield pa.record_batch([batch.column(0), pa.array([target] * len(made), pa.int32()), pa.array(starts, pa.int64()), pa.array(made, pa.list_(pa.float32()))], ["row", "rate", "first", "samples"])


def resample_chunks(chunks: DataFrame, run: str, target: int = CANONICAL_RATE, size: int = 1 << 15) -> DataFrame:
    """(``run``, chunk, rate, first, samples) at ``target`` of chunks (``run``, chunk, rate int, samples array<float>).

    Chunks of a run are numbered from 0 and hold ``size`` samples each, the last one any number. A chunk
    is filtered with the ends of its two neighbours, which they send it: two joins on (run, chunk), so a recording
    of any length is as many tasks' work as it has chunks, and no border leaves a step. ``first`` is the number of the chunk's
    first sample at the new rate. Samples that are null or no numbers count as silence; a chunk without a
    rate (null or below 1) is left out. Rates must have chunks longer than the filter reaches (some hundred samples).
    """
    rows = chunks.where("rate > 0 and chunk >= 0").select(run, "chunk", F.col("rate").cast("int").alias("rate"), "samples")
    rates = [r.rate for r in rows.select("rate").distinct().collect()]  # a handful
    far = max((reach(target // gcd(r, target), r // gcd(r, target)) for r in rates), default=1)
    if far > size:
        raise ValueError(f"chunks of {size} samples are shorter than the filter's reach of {far}")
    ends = rows.select(run, F.col("chunk") + 1, F.slice("samples", -F.least(F.size("samples"), F.lit(far)), F.lit(far))).toDF(run, "chunk", "before").where(F.size("before") > 0)
    heads = rows.select(run, F.col("chunk") - 1, F.slice("samples", 1, far)).toDF(run, "chunk", "after")
    met = rows.join(ends, [run, "chunk"], "left").join(heads, [run, "chunk"], "left")
    row = F.struct(F.col(run), F.col("chunk"))
    small_batches(chunks.sparkSession)  # else a worker holds thousands of chunks, each several times over
    asked = met.select(row.alias("row"), "rate", (F.col("chunk").cast("bigint") * size).alias("first"), "before", "samples", "after")
    kind = asked.schema["row"].dataType.simpleString()
    found = asked.mapInArrow(functools.partial(_chunks, target=target), f"row {kind}, rate int, first bigint, samples array<float>")
    return found.select(f"row.{run}", "row.chunk", "rate", "first", "samples")


def resample_runs(runs: DataFrame, run: str, target: int = CANONICAL_RATE, size: int = 1 << 15) -> DataFrame:
    """What ``resample_chunks`` gives for the chunks of runs (``run``, rate, samples) that fit in a row, cut and filtered where the run is read.

    A run's chunks have their neighbours in the same row, so nothing is joined or shuffled, and a worker holds a batch of runs and one chunk.
    The filter may reach beyond a chunk.
    """
    small_batches(runs.sparkSession)
    asked = runs.where("rate > 0 and size(samples) > 0").select(F.col(run).alias("run"), F.col("rate").cast("int").alias("rate"), "samples")
    kind = asked.schema["run"].dataType.simpleString()
    return asked.mapInArrow(functools.partial(_whole_runs, target=target, size=size), f"run {kind}, chunk int, rate int, first bigint, samples array<float>").withColumnRenamed("run", run)


def cut_in_chunks(runs: DataFrame, run: str, size: int = 1 << 15) -> DataFrame:
    """Chunks, as ``resample_chunks`` takes them, of runs (``run``, rate, samples) that fit in a row; a null or empty run has none."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / size).cast("int")), lambda k: F.slice(F.col("samples"), k * size + 1, size))
    return runs.where(F.size("samples") > 0).select(run, "rate", F.posexplode(parts).alias("chunk", "samples"))


def container(content: Column) -> Column:
    """struct<container, codec, lossless boolean> from a file's first bytes; nulls where they say nothing.

    Fixed values, public file signatures: RIFF/WAVE with its format tag (1 PCM, 3 float, 65534 extensible, 85 MP3), fLaC,
    OggS with the name of its first stream, EBML with its codec's name, ftyp with alac or mp4a, ID3 or an MPEG frame, FORM/AIFF.
    """
    head = F.substring(content, 1, 4096)
    text = F.decode(head, "ISO-8859-1")

    def at(start: int, n: int) -> Column:
        return F.substring(text, start, n)

    tag = F.conv(F.hex(F.concat(F.substring(head, 22, 1), F.substring(head, 21, 1))), 16, 10).cast("int")  # little-endian, after "fmt " and its size
    wave = F.when(at(13, 4) == "fmt ", F.when(tag.isin(1, 65534), "pcm").when(tag == 3, "float").when(tag == 85, "mp3"))
    inner = F.when(text.contains("OpusHead") | text.contains("A_OPUS"), "opus").when(text.contains("vorbis") | text.contains("A_VORBIS"), "vorbis").when(text.contains("FLAC"), "flac").when(text.contains("A_PCM"), "pcm")
    boxed = F.when(text.contains("alac"), "alac").when(text.contains("mp4a"), "aac")
    mpeg = F.conv(F.hex(F.substring(head, 1, 2)), 16, 10).cast("int").bitwiseAND(0xFFE0) == 0xFFE0

    def named(box: str, codec: Column) -> Column:
        return F.struct(F.lit(box).alias("container"), codec.alias("codec"))

    kind = (
        F.when((at(1, 4) == "RIFF") & (at(9, 4) == "WAVE"), named("wav", wave))
        .when(at(1, 4) == "fLaC", named("flac", F.lit("flac")))
        .when(at(1, 4) == "OggS", named("ogg", inner))
        .when(F.hex(F.substring(head, 1, 4)) == "1A45DFA3", named("webm", inner))
        .when(at(5, 4) == "ftyp", named("mp4", boxed))
        .when((at(1, 4) == "FORM") & at(9, 4).isin("AIFF", "AIFC"), named("aiff", F.lit("pcm")))
        .when((at(1, 3) == "ID3") | mpeg, named("mp3", F.lit("mp3")))
    )
    lossless = F.when(kind["codec"].isNotNull(), kind["codec"].isin("pcm", "float", "flac", "alac"))
    return F.struct(kind["container"].alias("container"), kind["codec"].alias("codec"), lossless.alias("lossless"))


def part_by_loss(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """The files that keep every sample, and all others, those of unknown kind among them; both with the column ``audio``."""
    marked = files.withColumn("audio", container(F.col(content)))
    keeps = F.coalesce(F.col("audio.lossless"), F.lit(False))
    return marked.where(keeps), marked.where(~keeps)
