"""Score files: MusicXML through Spark's XML source, bars unfolded by their repeats, notes on a tempo map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.joins import asof_backward
from tessera.plans import materialise

#: Fixed values of the data format: ticks of a quarter, the tempo without a mark, the shortest note in seconds.
QUARTER, TEMPO, SHORTEST = 960, 120.0, 0.05
#: Seconds of bars are added by 16, these sums by 16 again, and so on.
BLOCK, LEVELS = 16, 5
_NOTE = "struct<`_print-object`: string, chord: string, rest: string, grace: string, duration: bigint, voice: string, tie: array<struct<_type: string>>, notations: struct<technical: struct<string: int, fret: int>>>"
_SCHEMA = f"""_id string, measure array<struct<
  _number: string,
  attributes: array<struct<divisions: int, time: struct<beats: int, `beat-type`: int>>>,
  direction: array<struct<sound: struct<_tempo: double>>>,
  sound: array<struct<_tempo: double>>,
  barline: array<struct<_location: string, repeat: struct<_direction: string, _times: int>, ending: struct<_number: string, _type: string>>>,
  backup: array<struct<duration: bigint>>,
  note: array<{_NOTE}>>>"""


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(score, part, bars) of the ``part`` elements of MusicXML files (partwise); what is no such element is left out.

    ``score`` is the file's name. Elements that the schema does not name are passed over by the reader.
    """
    parts = spark.read.schema(_SCHEMA).option("rowTag", "part").option("attributePrefix", "_").xml(path)
    return parts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("score"), F.col("_id").alias("part"), F.col("measure").alias("bars"))


def bars_of(parts: DataFrame) -> DataFrame:
    """(score, part, bar, divisions, ticks, tempo, opens, closes, times, first, last, notes): a row a written bar, numbered from 0.

    Divisions and time signature hold until they change. ``opens`` and ``closes`` are repeat signs, ``times`` how often a
    closing one plays its bars (2 unless it says more); ``first`` to ``last`` are the passes in which an ending's bar is played.
    """
    rows = parts.select("score", "part", F.posexplode("bars").alias("bar", "m"))
    repeats = F.filter(F.col("m.barline.repeat"), lambda r: r.isNotNull())
    closing = F.filter(repeats, lambda r: r["_direction"] == "backward")
    starts = F.filter(F.filter(F.col("m.barline.ending"), lambda e: e.isNotNull()), lambda e: e["_type"] == "start")
    stops = F.filter(F.filter(F.col("m.barline.ending"), lambda e: e.isNotNull()), lambda e: e["_type"].isin("stop", "discontinue"))
    upto = Window.partitionBy("score", "part").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)  # a part's bars
    time = F.element_at(F.filter(F.col("m.attributes.time"), lambda t: t.isNotNull()), -1)
    divisions = F.element_at(F.filter(F.col("m.attributes.divisions"), lambda d: d.isNotNull()), -1)
    tempos = F.concat(F.coalesce(F.col("m.direction.sound._tempo"), F.array().cast("array<double>")), F.coalesce(F.col("m.sound._tempo"), F.array().cast("array<double>")))
    marked = rows.select(
        "score", "part", "bar",
        F.last(F.try_element_at(F.filter(F.col("m.attributes.divisions"), lambda d: d.isNotNull()), F.lit(-1)), ignorenulls=True).over(upto).alias("divisions"),
        F.last(F.try_element_at(F.filter(F.col("m.attributes.time"), lambda t: t.isNotNull()), F.lit(-1)), ignorenulls=True).over(upto).alias("time"),
        F.try_element_at(F.filter(tempos, lambda t: t > 0), F.lit(-1)).alias("tempo"),
        F.coalesce(F.exists(repeats, lambda r: r["_direction"] == "forward"), F.lit(False)).alias("opens"),
        F.coalesce(F.size(closing) > 0, F.lit(False)).alias("closes"),
        F.when(F.size(closing) > 0, F.coalesce(F.get(closing, F.lit(0))["_times"], F.lit(2))).alias("times"),
        F.when(F.size(starts) > 0, F.get(starts, F.lit(0))["_number"]).alias("ending"),
        F.coalesce(F.size(stops) > 0, F.lit(False)).alias("stops"),
        F.coalesce(F.col("m.note"), F.array().cast(f"array<{_NOTE}>")).alias("notes"),
    )
    # an ending's number holds from its start to its stop
    spans = Window.partitionBy("score", "part").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.max(F.when(F.col("stops"), F.col("bar"))).over(spans)
    opened = F.max(F.when(F.col("ending").isNotNull(), F.col("bar"))).over(upto)
    number = F.last("ending", ignorenulls=True).over(upto)
    held = marked.withColumn("ending", F.when(opened.isNotNull() & (F.coalesce(stopped, F.lit(-1)) < opened), number))
    passes = F.transform(F.split("ending", "[, ]+"), lambda n: n.try_cast("int"))
    ticks = F.round(QUARTER * 4 * F.coalesce(F.col("time.beats"), F.lit(4)) / F.coalesce(F.col("time.beat-type"), F.lit(4))).cast("bigint")
    return held.select("score", "part", "bar", F.coalesce("divisions", F.lit(1)).alias("divisions"), ticks.alias("ticks"), "tempo", "opens", "closes", "times", passes.alias("passes"), "notes")


def unfolded(bars: DataFrame) -> DataFrame:
    """(score, part, bar, pass, play): the bars as they are played, ``play`` from 0.

    A repeat is the bars from an opening sign (or the one after the last repeat, or the start) to a closing one; it is played
    ``times`` times, in each pass without the bars of other passes' endings. An ending after the closing sign belongs to the repeat
    before it, as its last pass. Written as windows that mark the sections and an explosion of each section's passes.
    """
    w = Window.partitionBy("score", "part").orderBy("bar")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    late = F.col("passes").isNotNull() & F.coalesce(F.lag("closes").over(w), F.lit(False))  # the ending after the repeat's sign
    tail = bars.withColumn("__late", late)
    # an ending of several bars: all of them follow the sign
    starts = F.when((F.col("opens") | F.coalesce(F.lag("closes").over(w), F.lit(False))) & ~F.col("__late"), 1).otherwise(0)
    left = F.when(F.col("passes").isNull() & F.lag("passes").over(w).isNotNull() & ~F.col("opens"), 1).otherwise(0)  # after the last ending
    cut = tail.withColumn("__cut", F.greatest(starts, F.when(F.coalesce(F.max(F.col("closes").cast("int")).over(before), F.lit(0)) == 1, left).otherwise(0)))
    placed = cut.withColumn("section", F.sum("__cut").over(upto))
    whole = Window.partitionBy("score", "part", "section")
    counted = placed.withColumn("__times", F.greatest(F.coalesce(F.max("times").over(whole), F.lit(1)), F.coalesce(F.max(F.array_max("passes")).over(whole), F.lit(1))))
    played = counted.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    heard = played.where(F.col("passes").isNull() | F.array_contains("passes", F.col("pass")))
    order = Window.partitionBy("score", "part").orderBy("section", "pass", "bar")
    return heard.select("score", "part", "bar", "pass", (F.row_number().over(order) - 1).alias("play"))


def tempo_map(bars: DataFrame, plays: DataFrame) -> DataFrame:
    """(score, part, play, bar, tick, bpm, start_s): where each played bar begins, in ticks and seconds; the last tempo mark of a bar holds from its start on."""
    met = plays.join(bars.select("score", "part", "bar", "ticks", "tempo"), ["score", "part", "bar"])
    upto = Window.partitionBy("score", "part").orderBy("play").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("score", "part").orderBy("play").rowsBetween(Window.unboundedPreceding, -1)
    timed = met.withColumn("bpm", F.coalesce(F.last("tempo", ignorenulls=True).over(upto), F.lit(TEMPO))).withColumn("tick", F.coalesce(F.sum("ticks").over(before), F.lit(0)))
    return sum_before(timed, F.col("ticks") * 60 / (F.col("bpm") * QUARTER), "start_s").select("score", "part", "play", "bar", "tick", "bpm", "start_s")


def sum_before(plays: DataFrame, value: Column, name: str) -> DataFrame:
    """``plays`` with the sum of ``value`` (double) over a part's earlier plays as ``name``, largest blocks first.

    A sum over tens of thousands of bars, one after the other, is off by enough to change the fourth digit of some times. Here no
    sum has more than ``BLOCK`` terms at each of ``LEVELS`` levels (at the last one, as many as the part has blocks of 65,536), so
    the error grows with the levels. Up to 32 plays it is the sum one after the other.
    """
    rows, terms = plays.withColumn("__sum", value), []
    for level in range(LEVELS):
        size = BLOCK**level
        block = [F.floor(F.col("play") / (size * BLOCK))] if level < LEVELS - 1 else []
        w = Window.partitionBy("score", "part", *block).orderBy("play")
        ready = F.when((F.col("play") + 1) % size == 0, F.col("__sum"))  # the sum of the block that ends here
        rows = rows.withColumns({f"__terms{level}": F.collect_list(ready).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__next": F.sum(ready).over(w.rowsBetween(Window.unboundedPreceding, 0))})
        rows = rows.withColumn("__sum", F.col("__next"))
        terms.insert(0, f"__terms{level}")
    return rows.withColumn(name, F.aggregate(F.concat(*terms), F.lit(0.0), lambda s, x: s + x)).drop("__sum", "__next", *terms)


def notes_of_bars(bars: DataFrame) -> DataFrame:
    """(score, part, bar, voice, beat, at, ticks, string, fret, tied, start): the notes of written bars, ``at`` in ticks from the bar's start.

    Notes of a chord share the beat of the first; rests move on and are left out, as are grace notes and notes without string or fret. Voices
    count from the bar's start each. ``tied``: the note only holds on an earlier one; ``start``: it is held on by a later one.
    """
    rows = bars.select("score", "part", "bar", "divisions", F.posexplode("notes").alias("pos", "n")).where("n.grace is null")
    rows = rows.withColumn("voice", F.coalesce("n.voice", F.lit("1"))).withColumn("in_chord", F.col("n.chord").isNotNull())
    w = Window.partitionBy("score", "part", "bar", "voice").orderBy("pos")  # a bar's notes
    steps = F.when(~F.col("in_chord"), F.coalesce("n.duration", F.lit(0))).otherwise(0)
    beat = F.sum((~F.col("in_chord")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    begun = F.coalesce(F.sum(steps).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("beat", beat).withColumn("moved", begun)
    first = F.min("moved").over(Window.partitionBy("score", "part", "bar", "voice", "beat"))  # a chord's notes begin where its first does
    tick = lambda c: F.round(c * QUARTER / F.col("divisions")).cast("bigint")
    ties = F.coalesce(F.col("n.tie._type"), F.array().cast("array<string>"))
    found = placed.select("score", "part", "bar", "voice", "beat", tick(first).alias("at"), tick(F.col("n.duration")).alias("ticks"), F.col("n.notations.technical.string").alias("string"), F.col("n.notations.technical.fret").alias("fret"), F.array_contains(ties, "stop").alias("tied"), F.array_contains(ties, "start").alias("start"), F.col("n.rest").isNotNull().alias("rest"))
    return found.where("not rest and string is not null and fret is not null").drop("rest")


def chart_of(parts: DataFrame, seven_strings: bool = False) -> DataFrame:
    """The flat notes (score, part, t, string, fret, dur, chord) of scores as they are played, repeats unfolded.

    A note that only holds on an earlier one is no onset; the earlier one keeps its own length, as in the files' other readers. Times
    come from the tempo map by an as-of join on ticks (J8), rounded to four digits; a note lasts ``SHORTEST`` at least. ``chord``
    counts the beats of a part with more than one note from 1, null for single ones. ``seven_strings`` turns string numbers over.
    """
    bars = materialise(bars_of(parts), "bars")
    map_ = materialise(tempo_map(bars, unfolded(bars)), "tempos")
    notes = notes_of_bars(bars).join(map_.select("score", "part", "bar", "play", F.col("tick").alias("bar_tick")), ["score", "part", "bar"])
    on = notes.withColumn("tick", F.col("bar_tick") + F.col("at")).withColumn("stop", F.col("bar_tick") + F.col("at") + F.col("ticks"))
    marks = map_.select("score", "part", "tick", F.struct("tick", "bpm", "start_s").alias("mark"))
    keys, width = ["score", "part"], 64.0 * 4 * QUARTER

    def seconds(tick: str, mark: Column) -> Column:
        return mark["start_s"] + (F.col(tick) - mark["tick"]) * 60 / (mark["bpm"] * QUARTER)

    def digits(c: Column) -> Column:
        """Four digits of the product, as SQL engines round: 7.66875 that a sum left at 7.668749999999999 still goes up."""
        return F.round(c * 1e4) / 1e4

    began = asof_backward(on, marks, keys, "tick", ["mark"], width).withColumnRenamed("mark", "began")
    # a note that ends with its bar ends by that bar's tempo, so the mark is the one of its last tick
    lasting = began.withColumnRenamed("tick", "on_tick").withColumn("tick", F.greatest("on_tick", F.col("stop") - 1))
    ended = asof_backward(lasting, marks, keys, "tick", ["mark"], width)
    t, stop = digits(seconds("on_tick", F.col("began"))), seconds("stop", F.col("mark"))
    # within one bar a length is one quotient, not the difference of two sums: 0.46875 s must not become 0.46874999
    inside = (F.col("stop") - F.col("on_tick")) * 60 / (F.col("mark.bpm") * QUARTER)
    lasts = F.when(F.col("mark.tick") == F.col("began.tick"), inside).otherwise(stop - seconds("on_tick", F.col("began")))
    heard = ended.withColumn("t", t).withColumn("dur", digits(F.greatest(F.lit(SHORTEST), lasts)))
    beat = ["score", "part", "play", "voice", "beat"]
    sizes = F.count("*").over(Window.partitionBy(*beat))
    chords = F.dense_rank().over(Window.partitionBy("score", "part").orderBy("play", "voice", "beat"))
    many = heard.withColumn("__many", sizes > 1)
    numbered = many.where("__many").withColumn("chord", chords.cast("bigint")).unionByName(many.where("not __many").withColumn("chord", F.lit(None).cast("bigint")))
    string = 7 - F.col("string") if seven_strings else F.col("string")
    return numbered.where("not tied").select("score", "part", "t", string.cast("int").alias("string"), "fret", "dur", "chord")
