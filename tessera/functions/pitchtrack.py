"""Probabilistic pitch: several candidates a frame, decoded along time."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import small_batches

#: Fixed values of the reference results: the range of pitches (E1 to E6), a frame's samples, the shortest window in seconds.
LOW, HIGH, FRAME, LEAST_S = 41.203444614108754, 1318.5102276514797, 4096, 0.05
#: Fixed values of the published method: the prior of the threshold (beta, 2 and 18, in steps of a hundredth), the share that a
#: frame's deepest dip gets for thresholds that no dip is below, octaves a second that a voice moves at most, and the chance to fall silent.
PRIOR, DEEPEST, GLIDE, SWITCH = (2.0, 18.0), 0.01, 35.92, 0.01


@functools.cache
def threshold_weights(steps: int = 100) -> np.ndarray:
    """The prior's mass for thresholds 1/steps, 2/steps, ..., 1."""
    x = (np.arange(4000) + 0.5) / 4000
    a, b = PRIOR
    mass = (x ** (a - 1) * (1 - x) ** (b - 1)).reshape(steps, -1).sum(axis=1)
    return mass / mass.sum()


def frame_starts(n: int, size: int) -> np.ndarray:
    return np.arange(0, max(n - size, 0) + 1, size // 4)


def candidates(frames: np.ndarray, rate: int, low: float = LOW, high: float = HIGH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each frame the pitches of its dips and their probabilities, which add up to the chance that it is voiced.

    The difference of a frame's halves at every lag is divided by its running mean; for each threshold the first dip below it
    gets the threshold's mass. A dip's lag and depth are those of the parabola through it.
    """
    size = frames.shape[1]
    half, shortest = size // 2, max(2, int(rate / high))
    longest = min(int(np.ceil(rate / low)) + 1, half - 1)
    lags = np.arange(longest + 1)
    points = 1 << (size - 1).bit_length()  # no lag below half a frame wraps around
    cross = np.fft.irfft(np.conj(np.fft.rfft(frames[:, :half], points, axis=1)) * np.fft.rfft(frames, points, axis=1), points, axis=1)[:, : longest + 1]
    energy = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    diff = np.maximum(energy[:, [half]] + energy[:, half : half + longest + 1] - energy[:, : longest + 1] - 2 * cross, 0)
    norm = np.ones_like(diff)
    norm[:, 1:] = diff[:, 1:] * lags[1:] / np.maximum(np.cumsum(diff[:, 1:], axis=1), 1e-12)
    norm[energy[:, -1] < 1e-10 * size] = 1.0  # silence has no dips
    weights = threshold_weights()
    levels = np.arange(1, len(weights) + 1) / len(weights)
    above = np.append(np.cumsum(weights[::-1])[::-1], 0.0)  # the mass of thresholds from the k-th on
    inner = norm[:, shortest:longest]
    dip = (inner < norm[:, shortest - 1 : longest - 1]) & (inner <= norm[:, shortest + 1 : longest + 1])
    dip &= (np.where(dip, inner, 1.0).min(axis=1, initial=1.0) < 1)[:, None]
    owner, lag = np.nonzero(dip)
    lag = lag + shortest
    a, b, c = norm[owner, lag - 1], norm[owner, lag], norm[owner, lag + 1]
    bend = a - 2 * b + c
    curved = np.abs(bend) > 1e-12
    shift = np.clip(np.where(curved, 0.5 * (a - c) / np.where(curved, bend, 1.0), 0.0), -0.5, 0.5)
    deep = np.maximum(b - 0.25 * (a - c) * shift, 0.0)
    # a dip gets the thresholds above it that no earlier dip of its frame is below
    counts = dip.sum(axis=1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    table = np.full((len(norm), 1 + counts.max(initial=0)), np.inf)
    table[owner, place + 1] = deep
    least = np.minimum.accumulate(table, axis=1)
    from_ = lambda depth: np.searchsorted(levels, depth, side="right")
    mass = above[from_(least[owner, place + 1])] - above[from_(least[owner, place])]
    deepest = np.flatnonzero(place == table.argmin(axis=1)[owner] - 1)
    mass[deepest] += DEEPEST * (above[0] - above[from_(deep[deepest])])
    keep = mass > 0
    hz, ends = (rate / (lag + shift))[keep], np.cumsum(np.bincount(owner[keep], minlength=len(norm)))[:-1]
    return list(zip(np.split(hz, ends), np.split(mass[keep], ends), strict=True)) if len(norm) else []


def decoded(frames: list[tuple[np.ndarray, np.ndarray]], hop_s: float) -> np.ndarray:
    """The likeliest pitch of each frame (NaN: unvoiced) by dynamic programming over neighbouring frames' candidates.

    A step costs by its width in octaves (a triangle as wide as a voice glides in a hop) and by a change of voicing;
    what a frame's candidates leave of its probability is the unvoiced state's.
    """
    reach = GLIDE * hop_s
    score, back, states = np.zeros(1), [], []
    before = np.full(1, np.nan)
    for k, (hz, mass) in enumerate(frames):
        own = np.append(np.log2(hz), np.nan)
        seen = np.log(np.append(np.clip(mass, 1e-12, 1), max(1 - mass.sum(), 1e-12)))
        voiced, was = ~np.isnan(own), ~np.isnan(before)
        near = np.maximum(1 - np.abs(own[None, :] - before[:, None]) / reach, 1e-9)
        step = np.where(was[:, None] & voiced[None, :], np.log((1 - SWITCH) * np.where(np.isnan(near), 1.0, near)), np.where(was[:, None] == voiced[None, :], np.log(1 - SWITCH), np.log(SWITCH)))
        total = score[:, None] + (step if k else np.zeros_like(step))
        back.append(total.argmax(axis=0))
        states.append(np.append(hz, np.nan))
        score, before = total.max(axis=0) + seen, own
    path, at = np.full(len(frames), np.nan), int(score.argmax())
    for k in range(len(frames) - 1, -1, -1):
        path[k] = states[k][at]
        at = int(back[k][at])
    return path


def _events(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Name (as an array), rate and the frames' candidates of every event with samples and a rate."""
    for batch in batches:
        names, rates = batch.column(0), batch.column(1).to_pylist()
        samples = batch.column(2).to_numpy(zero_copy_only=False)  # an array a row, None for null
        for i, (rate, x) in enumerate(zip(rates, samples, strict=True)):
            if not rate or rate < 0 or x is None or not len(x):
                continue
            x = np.nan_to_num(np.asarray(x, np.float64))
            x = np.pad(x, (0, max(size - len(x), 0)))
            cut = np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 4]
            yield names.slice(i, 1), rate, [c for at in range(0, len(cut), 256) for c in candidates(cut[at : at + 256], rate)]


def _named(name: pa.Array, n: int) -> tuple[pa.Array, pa.Array]:
    return name.take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(n, dtype=np.int32))


def _framed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0), *parts])))

    for name, _, found in _events(batches, size):
        yield pa.record_batch([*_named(name, len(found)), lists([f[0] for f in found]), lists([f[1] for f in found])], ["event_id", "frame", "hz", "mass"])


def _tracked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for name, rate, found in _events(batches, size):
        hop = size // 4 / rate
        hz = decoded(found, hop)
        yield pa.record_batch([*_named(name, len(found)), pa.array((np.arange(len(found)) + 1) * hop), pa.array(hz, mask=np.isnan(hz))], ["event_id", "frame", "t", "hz"])


def _sounding(events: DataFrame) -> DataFrame:
    small_batches(events.sparkSession, 16)
    return events.select(F.col("event_id").cast("string").alias("event_id"), F.col("rate").cast("int").alias("rate"), "samples")


def pitch_candidates(events: DataFrame, size: int = FRAME) -> DataFrame:
    """(event_id, frame, hz array, mass array) of every frame of events (event_id, rate, samples array<float>).

    Frames of ``size`` samples begin every quarter of it; a shorter event is one frame, filled with silence. An event is
    a row, its frames are cut where it is read and analysed 256 at a time. Null samples count as 0; events without samples or a rate have no frames.
    """
    return _sounding(events).mapInArrow(functools.partial(_framed, size=size), "event_id string, frame int, hz array<double>, mass array<double>")


def pitch_tracks(events: DataFrame, size: int = FRAME) -> DataFrame:
    """(event_id, frame, t, hz) of each frame of ``events``; hz is null where it is unvoiced, t the middle of the half that lags are taken of.

    An event's frames are decoded in order where its row is read, from a few numbers a frame: no shuffle, so as many tasks as the events are dealt to.
    """
    return _sounding(events).mapInArrow(functools.partial(_tracked, size=size), "event_id string, frame int, t double, hz double")


def event_pitch(events: DataFrame, least_s: float = LEAST_S, size: int = FRAME) -> DataFrame:
    """(event_id, f0_hz, voiced): the median pitch of each event's voiced frames and their number; null if none is, or if the window is shorter than ``least_s``."""
    asked = events.select(F.col("event_id").cast("string").alias("event_id"), (F.size("samples") >= least_s * F.col("rate")).alias("long")).distinct()
    tracks = pitch_tracks(events.where(F.size("samples") >= least_s * F.col("rate")), size)
    found = tracks.groupBy("event_id").agg(F.percentile("hz", 0.5).alias("f0_hz"), F.count("hz").alias("voiced"))
    return asked.join(found, "event_id", "left").select("event_id", "f0_hz", F.coalesce("voiced", F.lit(0)).alias("voiced"))
