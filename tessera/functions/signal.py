"""Features of a window of samples, as NumPy kernels inside Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.contract import AUDIO_FEATURES, RESIDUAL_FEATURES

_EPS = 1e-12


def frames(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Frames of the largest power of two in [256, 2048] that fits, a quarter apart; size and hop. Zero-padded at the end."""
    size = int(2 ** np.clip(np.floor(np.log2(max(len(x), 256))), 8, 11))
    hop = size // 4
    count = 1 + max(0, -(-(len(x) - size) // hop))
    padded = np.zeros(size + (count - 1) * hop)
    padded[: min(len(x), len(padded))] = x[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop], size, hop


def magnitudes(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude spectrum of each frame under a Hann window, and its frequencies."""
    f, size, _ = frames(x)
    return np.abs(np.fft.rfft(f * np.hanning(size), axis=1)), np.fft.rfftfreq(size, 1 / rate)


def _share_below(power: np.ndarray, freqs: np.ndarray, share: float) -> np.ndarray:
    upto = np.cumsum(power, axis=1)
    return freqs[(upto >= share * upto[:, -1:]).argmax(axis=1)]


def yin(x: np.ndarray, rate: int, low: float = 60.0, high: float = 1200.0) -> float:
    """Median pitch by the cumulative mean normalised difference; NaN if the window is too short or unvoiced."""
    longest = int(rate / low)
    size = 2 * longest
    if len(x) < size:
        return float("nan")
    w = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, longest // 2)]
    points = 1 << (size - 1).bit_length()  # no lag up to ``longest`` wraps around
    cross = np.fft.irfft(np.conj(np.fft.rfft(w[:, :longest], points)) * np.fft.rfft(w, points), points)[:, : longest + 1]
    energy = np.concatenate([np.zeros((len(w), 1)), np.cumsum(w * w, axis=1)], axis=1)
    diff = energy[:, [longest]] + (energy[:, longest : 2 * longest + 1] - energy[:, : longest + 1]) - 2 * cross
    norm = diff * np.arange(longest + 1) / np.maximum(np.cumsum(diff, axis=1), _EPS)
    norm[:, 0] = 1.0
    first = int(rate / high)
    below = norm[:, first:-1] < 0.15
    norm = norm[below.any(axis=1)]
    if not len(norm):
        return float("nan")
    lag = first + below[below.any(axis=1)].argmax(axis=1)
    # from there down to the dip's bottom, at ``longest`` at the latest
    up = np.concatenate([norm[:, 1:longest] >= norm[:, : longest - 1], np.ones((len(norm), 1), bool)], axis=1)
    lag = (up & (np.arange(longest) >= lag[:, None])).argmax(axis=1)
    a, b, c = (norm[np.arange(len(norm)), lag + k] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    curved = np.abs(bend) > _EPS
    shift = np.where(curved, 0.5 * (a - c) / np.where(curved, bend, 1.0), 0.0)
    return float(np.median(rate / (lag + shift)))


@functools.lru_cache(16)
def _mel_bank(bins: int, top: float, bands: int) -> np.ndarray:
    """Triangles (bands x bins) between frequencies that are equally far apart in mel, for bins from 0 to ``top``."""
    freqs = np.linspace(0, top, bins)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), bands + 2) / 2595) - 1)
    up = (freqs[None, :] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], _EPS)[:, None]
    down = (edges[2:, None] - freqs[None, :]) / np.maximum(edges[2:] - edges[1:-1], _EPS)[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def mel_cepstrum(power: np.ndarray, freqs: np.ndarray, n: int, bands: int = 40) -> np.ndarray:
    """Mean of the first ``n`` cosine coefficients of log mel energies."""
    logs = 10 * np.log10(np.maximum(power @ _mel_bank(len(freqs), float(freqs[-1]), bands).T, 1e-10))
    basis = np.cos(np.pi * np.arange(n)[:, None] * (np.arange(bands)[None, :] + 0.5) / bands) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return (logs @ basis.T).mean(axis=0)


@functools.cache
def _median_network(width: int) -> list[tuple[int, int, bool, bool]]:
    """Comparators (i, j, whether the smaller stays at i, whether the larger stays at j) after which the middle of ``width`` numbers is in the middle.

    Batcher's sorting network without what the middle does not depend on.
    """
    pairs, p = [], 1
    while p < width:
        k = p
        while k:
            pairs += [(i + j, i + j + k) for j in range(k % p, width - k, 2 * k) for i in range(min(k, width - j - k)) if (i + j) // (2 * p) == (i + j + k) // (2 * p)]
            k //= 2
        p *= 2
    needed, kept = {width // 2}, []
    for i, j in reversed(pairs):
        if i in needed or j in needed:
            kept.append((i, j, i in needed, j in needed))
            needed |= {i, j}
    return kept[::-1]


def _median_filter(x: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Medians of an odd ``width``: the shifted planes pass a sorting network together."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (width // 2, width // 2)
    padded, n = np.pad(x, pad, mode="reflect" if x.shape[axis] > width // 2 else "edge"), x.shape[axis]
    planes = [padded[k : k + n] if axis == 0 else padded[:, k : k + n] for k in range(width)]
    for i, j, low, high in _median_network(width):
        a, b = planes[i], planes[j]
        if low:
            planes[i] = np.minimum(a, b)
        if high:
            planes[j] = np.maximum(a, b)
    return planes[width // 2]


def harmonic_percussive(mag: np.ndarray, width: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive part of a spectrogram (frames x bins) by medians over time and frequency."""
    harmonic, percussive = _median_filter(mag, width, 0) ** 2, _median_filter(mag, width, 1) ** 2
    share = harmonic / np.maximum(harmonic + percussive, _EPS)
    return mag * share, mag * (1 - share)


def audio_features(x: np.ndarray, rate: int) -> dict[str, float]:
    """The 28 features; those that the window does not allow are NaN. Below 256 samples only rms and zcr are known."""
    out = dict.fromkeys(AUDIO_FEATURES, float("nan"))
    x = np.nan_to_num(np.asarray(x, np.float64))
    if not len(x):
        return out
    out["rms"], out["zcr"] = float(np.sqrt(np.mean(x * x))), float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1]))) if len(x) > 1 else 0.0
    if len(x) < 256:
        return out
    mag, freqs = magnitudes(x, rate)
    power, total = mag**2, np.maximum(mag.sum(axis=1), _EPS)
    centre = (mag * freqs).sum(axis=1) / total
    out["spec_centroid"] = float(centre.mean())
    out["spec_bandwidth"] = float(np.sqrt((mag * (freqs[None, :] - centre[:, None]) ** 2).sum(axis=1) / total).mean())
    out["spec_flatness"] = float((np.exp(np.log(np.maximum(power, 1e-10)).mean(axis=1)) / np.maximum(power, 1e-10).mean(axis=1)).mean())
    out["spec_rolloff"] = float(_share_below(mag, freqs, 0.85).mean())
    out["spec_flux"] = float(np.maximum(np.diff(10 * np.log10(np.maximum(power, 1e-10)), axis=0), 0).mean()) if len(mag) > 1 else 0.0
    out["buzz_band_ratio"] = float(power[:, freqs >= 4000].sum() / max(power.sum(), _EPS))
    f, _, hop = frames(x)
    loud = np.sqrt((f * f).mean(axis=1))
    peak, step = int(loud.argmax()), hop / rate
    if peak:
        out["log_attack_time"], out["attack_slope"] = float(np.log10(peak * step)), float((loud[peak] - loud[0]) / (peak * step))
    tail = np.log(np.maximum(loud[peak:], 1e-10))
    if len(tail) >= 2:
        out["decay_rate"] = float(np.polyfit(np.arange(len(tail)) * step, tail, 1)[0])
    harmonic, percussive = harmonic_percussive(mag)
    out["hnr"] = float(10 * np.log10(max((harmonic**2).sum(), _EPS) / ((percussive**2).sum() + 1e-10)))
    chroma = np.zeros(12)
    tones = np.flatnonzero(freqs > 27)
    np.add.at(chroma, np.mod(np.rint(69 + 12 * np.log2(freqs[tones] / 440)).astype(int), 12), power.mean(axis=0)[tones])
    out["chroma_peak"] = float((chroma / max(chroma.max(), _EPS)).max())
    f0 = yin(x, rate)
    if np.isfinite(f0) and f0 > 0:
        midi = 69 + 12 * np.log2(f0 / 440)
        out["pitch_cents_dev"] = float((midi - np.rint(midi)) * 100)
        out["inharmonicity"] = _inharmonicity(mag.mean(axis=0), freqs, f0)
    out |= {f"mfcc_{i + 1}": float(v) for i, v in enumerate(mel_cepstrum(power, freqs, 13))}
    return out


def _inharmonicity(mean: np.ndarray, freqs: np.ndarray, f0: float) -> float:
    """Mean relative distance of the spectrum's peaks to their harmonics 1..20."""
    inner = mean[1:-1]
    peaks = freqs[1:-1][(inner > mean[:-2]) & (inner >= mean[2:]) & (inner > 0.1 * mean.max())]
    off = []
    for k in range(1, 21):
        if k * f0 > freqs[-1] or not len(peaks):
            break
        gap = np.abs(peaks - k * f0).min()
        if gap <= max(1.5 * freqs[1], 0.03 * k * f0):
            off.append(gap / (k * f0))
    return float(np.mean(off)) if off else float("nan")


def residual_features(x: np.ndarray, rate: int, pitches: np.ndarray) -> dict[str, float]:
    """X11: what is left once bins near the harmonics 1..8 of every expected pitch are gone."""
    out = dict.fromkeys(RESIDUAL_FEATURES, float("nan"))
    x = np.nan_to_num(np.asarray(x, np.float64))
    if len(x) < 256:
        return out
    mag, freqs = magnitudes(x, rate)
    keep = np.ones(len(freqs), bool)
    for hz in pitches:
        for k in range(1, 9):
            keep &= np.abs(freqs - k * hz) > max(1.5 * freqs[1], k * hz * (2 ** (70 / 1200) - 1))
    power = mag**2
    rest = (power * keep).mean(axis=0)
    total = max(rest.sum(), _EPS)
    out["res_energy_ratio"] = float(rest.sum() / max(power.mean(axis=0).sum(), _EPS))
    out["res_centroid"] = float((freqs * rest).sum() / total)
    kept = np.maximum(rest[keep], 1e-10)
    out["res_flatness"] = float(np.exp(np.log(kept).mean()) / kept.mean()) if len(kept) else float("nan")
    out["res_highband_ratio"] = float(rest[freqs >= 4000].sum() / total)
    out["res_rolloff"] = float(_share_below(rest[None, :], freqs, 0.85)[0])
    _, percussive = harmonic_percussive(mag)
    out["perc_ratio"] = float((percussive**2).sum() / max(power.sum(), _EPS))
    return out | {f"res_mfcc_{i + 1}": float(v) for i, v in enumerate(mel_cepstrum((power * keep), freqs, 5))}


def harmonic_presence(x: np.ndarray, rate: int, f0: float) -> float:
    """Share of the power in [f0 / 2, 6.6 f0] within 60 cents of the harmonics 1..6."""
    if len(x) < 256 or not f0 > 0:
        return float("nan")
    x = np.asarray(x, np.float64)
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2  # the whole window: a frame's bins are wider than the bands
    freqs = np.fft.rfftfreq(len(x), 1 / rate)
    near = np.zeros(len(freqs), bool)
    for k in range(1, 7):
        near |= np.abs(1200 * np.log2(np.maximum(freqs, 1e-6) / (k * f0))) <= 60
    span = (freqs >= f0 / 2) & (freqs <= 6.6 * f0)
    return float(power[near & span].sum() / max(power[span].sum(), _EPS))


def onset_envelope(x: np.ndarray, rate: int, hop: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(time, strength): mean rise of the log spectrum from frame to frame."""
    size = 4 * hop
    padded = np.concatenate([np.zeros(size // 2), np.asarray(x, np.float64), np.zeros(size // 2)])
    f = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    logs = 10 * np.log10(np.maximum(np.abs(np.fft.rfft(f * np.hanning(size), axis=1)) ** 2, 1e-10))
    logs = np.maximum(logs, logs.max() - 80)
    return np.arange(len(f)) * hop / rate, np.concatenate([[0], np.maximum(np.diff(logs, axis=0), 0).mean(axis=1)])


def tone(hz: Column, shares: Sequence[float], rate: int, n: int) -> Column:
    """``n`` samples (array<float>) of the tone ``hz`` with a share of the full level for each of its harmonics from the first on."""

    @F.arrow_udf("array<float>")
    def sound(pitch: pa.Array) -> pa.Array:
        at = np.arange(n)
        made = np.empty((len(pitch), n), np.float32)  # never lists of numbers, which are many times as large
        for row, p in zip(made, pitch.to_numpy(zero_copy_only=False), strict=True):
            row[:] = sum(share * np.sin(2 * np.pi * p * k * at / rate) for k, share in enumerate(shares, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(pitch) + 1) * n, pa.int32()), pa.array(made.reshape(-1)))

    return sound(hz)


def extract(windows: DataFrame) -> DataFrame:
    """Windows (event_id, rate, samples) to a row of AUDIO_FEATURES each; null where a feature is not defined. Every window yields a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [audio_features(np.zeros(0) if s is None else s, int(r) if r == r and r else 1) for s, r in zip(batch["samples"], batch["rate"], strict=True)]
            out = pd.DataFrame(rows, columns=AUDIO_FEATURES).astype(object)
            yield pd.concat([batch[["event_id"]].reset_index(drop=True), out.where(out.notna(), None)], axis=1)

    return windows.select("event_id", "rate", "samples").mapInPandas(run, "event_id string, " + ", ".join(f"{f} double" for f in AUDIO_FEATURES))


def extract_residual(windows: DataFrame) -> DataFrame:
    """X11: windows (event_id, rate, samples, pitches) to RESIDUAL_FEATURES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [residual_features(np.zeros(0) if s is None else s, int(r) if r == r and r else 1, np.asarray([] if p is None else p)) for s, r, p in zip(batch["samples"], batch["rate"], batch["pitches"], strict=True)]
            out = pd.DataFrame(rows, columns=RESIDUAL_FEATURES).astype(object)
            yield pd.concat([batch[["event_id"]].reset_index(drop=True), out.where(out.notna(), None)], axis=1)

    return windows.select("event_id", "rate", "samples", "pitches").mapInPandas(run, "event_id string, " + ", ".join(f"{f} double" for f in RESIDUAL_FEATURES))


def onset_peaks(runs: DataFrame) -> DataFrame:
    """Runs (run_id, rate, samples) to rows (run_id, t, strength) of the onset envelope."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [(name, *onset_envelope(samples, int(rate))) for name, rate, samples in zip(batch["run_id"], batch["rate"], batch["samples"], strict=True) if samples is not None and len(samples)]
            if held:
                names, t, s = zip(*held, strict=True)
                yield pd.DataFrame({"run_id": np.repeat(np.array(names, object), [len(x) for x in t]), "t": np.concatenate(t), "strength": np.concatenate(s)})

    return runs.select("run_id", "rate", "samples").mapInPandas(run, "run_id string, t double, strength double")
