"""Charts, chords and channels: nested charts to notes, notes to actuator channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import seeded_shuffle


def notes_of(tabs: DataFrame, bpm: Column | None = None, step_s: float = 0.95) -> DataFrame:
    """(tab_id, event, t, string, fret) of charts (tab_id, events array<struct<notes array<struct<string,fret>>, strum_ms>>).

    Events without a valid note (string 1..6, fret >= 0) are dropped and do not take time. Time
    runs in steps of a beat of ``bpm``, or of ``step_s`` seconds.
    """
    valid = lambda n: n["string"].between(1, 6) & (n["fret"] >= 0)
    kept = F.filter(F.transform("events", lambda e: F.filter(e["notes"], valid)), lambda ns: F.size(ns) > 0)
    step = F.lit(step_s) if bpm is None else 60.0 / bpm
    events = tabs.select("tab_id", step.alias("__step"), F.posexplode(kept).alias("event", "notes"))
    return events.select("tab_id", "event", (F.col("event") * F.col("__step")).alias("t"), F.explode("notes").alias("n")).select("tab_id", "event", "t", "n.string", "n.fret")


def fingers_of(chords: DataFrame, shape: Column, fingers: Column) -> DataFrame:
    """(columns, finger, string, fret): fretted strings with a finger 1..4; of a finger's strings the last one counts. Strings run 6 to 1."""
    cells = F.filter(F.transform(F.arrays_zip(shape.alias("fret"), fingers.alias("finger")), lambda c, i: F.struct(c["finger"].alias("finger"), i.alias("i"), c["fret"].alias("fret"))), lambda c: (c["fret"] > 0) & c["finger"].between(1, 4))
    last = F.filter(cells, lambda c: ~F.exists(cells, lambda d: (d["finger"] == c["finger"]) & (d["i"] > c["i"])))
    return chords.select("*", F.explode(last).alias("__c")).select(*chords.columns, F.col("__c.finger").alias("finger"), (6 - F.col("__c.i")).alias("string"), F.col("__c.fret").alias("fret"))


def corrected_chord(name: Column, shape: Column, corrections: dict[str, list[int]]) -> Column:
    """The shape, replaced for chords with a known correction."""
    table = F.create_map(*[x for k, v in corrections.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return F.coalesce(F.element_at(table, name), shape)


def strum_sweep(notes: DataFrame, event: list[str], gap_s: float = 0.040) -> DataFrame:
    """Onset offset of each note of a strum, from the lowest string (6) up."""
    return notes.withColumn("offset_s", (F.row_number().over(Window.partitionBy(*event).orderBy(F.col("string").desc(), "fret")) - 1) * gap_s)


def note_channels(string: Column, fret: Column) -> Column:
    """Channels of a note: the string's back channel 1..6, and zone channel 7..12 for frets 1..6."""
    return F.filter(F.array(F.when(string.between(1, 6), string), F.when(fret.between(1, 6), fret + 6)), lambda c: c.isNotNull())


def route(channels: DataFrame, devices: DataFrame) -> DataFrame:
    """Channels (ch, jack, side, box) with their hardware (jack, side, hw); the second box lies 8 higher if both share a device."""
    shared = devices.agg((F.count_distinct("device") == 1).alias("one"))
    met = channels.join(devices, ["jack", "side"], "left").join(shared, F.lit(True))  # one row
    return met.select(*channels.columns, (F.col("hw") + F.when(F.col("one") & (F.col("box") == "V2"), 8).otherwise(0)).alias("hw"))


def correction_priority(note_ok: Column, duration_ok: Column, pressure_ok: Column) -> Column:
    """The first thing to correct: note, then duration, then pressure; ok if nothing."""
    return F.when(~note_ok, "note").when(~duration_ok, "duration").when(~pressure_ok, "pressure").otherwise("ok")


def plan_runs(passes: DataFrame, strings: list[int], classes: list[str], seed: int) -> DataFrame:
    """For every row of ``passes`` (pass) every string and class, classes in an order drawn anew for each pass and string."""
    grid = passes.select("pass", F.explode(F.array(*[F.lit(s) for s in strings])).alias("string")).select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    return seeded_shuffle(grid, ["pass", "string"], F.col("class"), seed)


def chart_of_sequence(steps: DataFrame, chart: Sequence[str], order: str, name: str, repeats: int, bpm: float) -> DataFrame:
    """(chart, pos, name, t): the names of each chart's steps, in order and repeated, at the beats of a tempo.

    A chart is short; its steps are ordered by one task. Null names are rests and keep their beat.
    """
    by = Window.partitionBy(*chart)
    placed = steps.select(*chart, F.col(name).alias("name"), (F.row_number().over(by.orderBy(order)) - 1).alias("__i"), F.count(F.lit(1)).over(by).alias("__n"))
    turns = placed.select(*chart, "name", "__i", "__n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__turn")) if repeats > 0 else placed.withColumn("__turn", F.lit(0)).limit(0)
    found = turns.withColumn("pos", F.col("__turn") * F.col("__n") + F.col("__i"))
    return found.select(*chart, "pos", "name", (F.col("pos") * 60.0 / bpm).alias("t"))
