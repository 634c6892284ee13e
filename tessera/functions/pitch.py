"""Pitch and fret arithmetic as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.contract import OPEN_MIDI

FRETS_ON_BOARD = 7


def hz_to_midi(hz: Column) -> Column:
    """69 + 12 log2(hz / 440); null for null, NaN and non-positive input."""
    return F.when((hz > 0) & ~F.isnan(hz), 69 + 12 * F.log2(hz / 440))


def midi_to_hz(midi: Column) -> Column:
    """the inverse of hz_to_midi."""
    return 440 * F.pow(F.lit(2.0), (midi - 69) / 12)


def cents_off(midi: Column) -> Column:
    """distance to the nearest semitone in cents; halves go to the even one."""
    return (midi - F.rint(midi)) * 100


def fret_fraction(n: Column, scale: float = 1.0) -> Column:
    """place of fret n in equal temperament, from the nut."""
    return scale * (1 - F.pow(F.lit(2.0), -n / 12))


def fret_unit(fret: Column, last: int = FRETS_ON_BOARD) -> Column:
    """the middle of a fret's cell as a share of the board up to fret ``last``; 0 for the open string."""
    middle = (fret_fraction(fret) + fret_fraction(fret - 1)) / 2
    return F.when(fret > 0, middle).otherwise(0.0) / fret_fraction(F.lit(float(last)))


def nearest_fret(board_x: Column, last: int = FRETS_ON_BOARD) -> Column:
    """Fret 0..last whose wire is nearest to board_x; the lower one of equals."""
    far = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda n: F.struct(F.abs(board_x - fret_fraction(n.cast("double"))).alias("far"), n.alias("n")))
    return F.when(board_x.isNotNull(), F.array_min(far)["n"])


def behind_wire(board_x: Column, fret: Column) -> Column:
    """F8: distance to the fret's wire; negative towards the nut."""
    return board_x - fret_fraction(fret.cast("double"))


def string_at(board_y: Column) -> Column:
    """string 6..1 at share board_y across the board, halves to even."""
    return F.least(F.lit(6), F.greatest(F.lit(1), 6 - F.rint(board_y * 5).cast("int")))


def position_of(midi: Column, string: Column) -> Column:
    """Struct (string, fret) of a pitch.

    A known string is taken as it is, its fret may be out of range. Otherwise the
    string among 6..1 on which the pitch lies nearest to a fret of 0..12 wins, the first
    of equals in that order; null if none has it in range.
    """
    open_of = F.element_at(F.create_map(*[F.lit(x) for kv in OPEN_MIDI.items() for x in kv]), string)
    known = F.struct(string.cast("int").alias("string"), F.rint(midi - open_of).cast("int").alias("fret"))
    tried = F.array(*[F.struct(F.abs(midi - m - F.rint(midi - m)).alias("off"), F.lit(i).alias("order"), F.lit(s).alias("string"), F.rint(midi - m).cast("int").alias("fret")) for i, (s, m) in enumerate(OPEN_MIDI.items())])
    best = F.array_min(F.filter(tried, lambda t: t["fret"].between(0, 12)))
    return F.when(midi.isNotNull(), F.when(open_of.isNotNull(), known).otherwise(F.when(best.isNotNull(), F.struct(best["string"].alias("string"), best["fret"].alias("fret")))))


def expected_pitches(chord: Column, string: Column, fret: Column, f0_hz: Column) -> Column:
    """pitches in Hz: of a chord's sounding strings (fret >= 0, from string 6 on), else of string and fret, else the measured one, else none."""
    opens = F.array(*[F.lit(m) for m in OPEN_MIDI.values()])
    sounding = F.filter(F.transform(chord, lambda f, i: F.when(f >= 0, midi_to_hz(opens[i] + f))), lambda x: x.isNotNull())
    open_of = F.element_at(F.create_map(*[F.lit(x) for kv in OPEN_MIDI.items() for x in kv]), string)
    single = F.when(open_of.isNotNull() & (fret >= 0), F.array(midi_to_hz(open_of + fret)))
    return F.coalesce(F.when(F.size(sounding) > 0, sounding), single, F.when(f0_hz > 0, F.array(f0_hz)), F.array().cast("array<double>"))


def envelope(lead: Column, length: Column) -> Column:
    """brightness of a coming note: quadratic over the 2.2 s before it, falling while it sounds, gone 0.25 s after."""
    return (
        F.when((lead > 2.2) | (lead < -length - 0.25), 0.0)
        .when(lead > 0, F.pow(1 - lead / 2.2, F.lit(2.0)))
        .when(lead >= -length, 1 + 0.5 * lead / F.greatest(length, F.lit(1e-9)))
        .otherwise(0.5 * (1 + (lead + length) / 0.25))
    )


def tone(hz: Column, seconds: float, rate: int = 8000) -> Column:
    """samples of a tone under a raised cosine."""
    n = int(seconds * rate)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(2 * F.pi() * hz * i / rate) * 0.5 * (1 - F.cos(2 * F.pi() * i / (n - 1))))


def glide(low: Column, high: Column, seconds: float, rate: int = 8000) -> Column:
    """samples of a linear chirp."""
    n = int(seconds * rate)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(2 * F.pi() * (low * i / rate + (high - low) * i * i / (2 * rate * rate * seconds))))


def pulse_train(pulse: Column, rest: Column, times: Column) -> Column:
    """a pulse and a rest, ``times`` over."""
    return F.flatten(F.array_repeat(F.concat(pulse, rest), times))
