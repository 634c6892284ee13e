"""Running state machines on streams and on tables, and the streaming session audit."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans import materialise
from tessera.streaming.machines import Machine


def _plain(value):
    """Arrow's arrays, NaN and NumPy numbers as the machines expect them."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if isinstance(value, np.generic) else value


def _fold(machine: Machine, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    out = []
    for row in zip(*[rows[c] for c in machine.inputs], strict=True):
        state, made = machine.step(state, tuple(map(_plain, row)))
        out.append(made)
    return state, out


def _schema(df: DataFrame, machine: Machine, key: str, order: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in [key, *order]), machine.output])


def _frame(key: str, order: Sequence[str], machine: Machine, rows: pd.DataFrame, out: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in machine.output.replace(", ", ",").split(",")]
    made = pd.DataFrame(out, columns=names, dtype=object)
    return pd.concat([rows[[key, *order]].reset_index(drop=True), made], axis=1)


def on_stream(df: DataFrame, machine: Machine, key: str, order: Sequence[str], idle: str | None = None) -> DataFrame:
    """A machine for each key of a stream; T5: a new key starts anew. Rows of a micro-batch are taken in ``order``.

    ``idle`` (milliseconds as text) drops the state of a key that has been silent so long.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(map(_plain, state.get)) if state.exists else machine.start
        rows = pd.concat(list(batches)).sort_values(list(order), ignore_index=True)
        now, out = _fold(machine, now, rows)
        state.update(now)
        if idle:
            state.setTimeoutDuration(int(idle))
        yield _frame(key, order, machine, rows, out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, _schema(df, machine, key, order), machine.state, "append", timeout)


def on_table(df: DataFrame, machine: Machine, key: str, order: Sequence[str]) -> DataFrame:
    """The batch twin: the same machine over rows sorted by (key, order).

    A key's rows are read once in order, batch by batch, with the state carried on, so memory
    does not grow with a key; being sequential, a key is one task's work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, machine.start
        for batch in batches:
            for name, rows in batch.groupby(key, sort=False, dropna=False):
                if name != current:
                    current, state = name, machine.start
                state, out = _fold(machine, state, rows)
                yield _frame(key, order, machine, rows, out)

    columns = list(dict.fromkeys([key, *order, *machine.inputs]))
    return df.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, _schema(df, machine, key, order))


_CELL = ("__key", "__bucket")


def _states(batches: Iterator[pd.DataFrame], inputs: Sequence[str], first, step) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Per batch of sorted rows what ``step(state, row)`` gives for each row, and the cells (key and bucket) that ended, with their last state; ``first(entry)`` begins one."""
    cell = state = entry = None
    for batch in batches:
        made, ended = [], []
        entries = batch["__entry"].tolist() if "__entry" in batch else [None] * len(batch)
        for k, b, e, row in zip(batch["__key"].tolist(), batch["__bucket"].tolist(), entries, zip(*[batch[c] for c in inputs], strict=True), strict=True):
            if (k, b) != cell:
                if cell is not None:
                    ended.append((*cell, entry, state))
                cell, entry, state = (k, b), e, first(e)
            state, out = step(state, tuple(map(_plain, row)))
            made.append(out)
        yield batch, made, ended
    if cell is not None:
        yield None, [], [(*cell, entry, state)]


def in_buckets(df: DataFrame, machine: Machine, key: str, order: Sequence[str], width: float) -> DataFrame:
    """``on_table`` with a key's rows in time buckets (``order[0]`` in steps of ``width``), each a task's work of its own.

    Every bucket runs from a guess of the state in which it is entered and says in what state it is left; buckets that
    are entered in another state than guessed run again until all agree, so the result is that of the whole sequence, to the last
    bit. Machines that can compose what rows do (affine maps for T9, maxima for T11) guess well: each bucket's rows become one map, and
    a row a bucket gives the states. All others (two-state triggers as T7) guess the start; those that
    forget need a round or two. The worst case, a state that crosses every bucket unchanged, takes a round a bucket.

    Rows of a null key are a key's; a null time is a bucket of its own, before all others. Buckets are read in order, batch by batch, with
    the state carried on, so memory does not grow with them.
    """
    columns = list(dict.fromkeys([key, *order, *machine.inputs]))
    bucket = F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(1 << 62))).cast("bigint")
    named = F.coalesce(F.to_json(F.struct(F.col(key).alias("k"))), F.lit(""))  # null-safe
    rows = materialise(df.select(*columns, named.alias("__key"), bucket.alias("__bucket")), "rows")

    def dealt(part: DataFrame) -> DataFrame:
        return part.repartition(*_CELL).sortWithinPartitions(*_CELL, *order)

    def lifted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        add = lambda made, row: (machine.lift(row) if made is None else machine.compose(made, machine.lift(row)), None)
        for _, _, ended in _states(batches, machine.inputs, lambda e: None, add):
            yield pd.DataFrame([(k, b, json.dumps(made)) for k, b, _, made in ended], columns=[*_CELL, "__map"], dtype=object)

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, ended in _states(batches, machine.inputs, lambda e: tuple(json.loads(e)), machine.step):
            yield pd.DataFrame([(k, b, e, json.dumps(state)) for k, b, e, state in ended], columns=[*_CELL, "__entry", "__exit"], dtype=object)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, made, _ in _states(batches, machine.inputs, lambda e: tuple(json.loads(e)), machine.step):
            if batch is not None:
                yield _frame(key, order, machine, batch, made)

    cell = "__key string, __bucket bigint"
    if machine.compose is not None:
        guess = _entries_composed(dealt(rows).mapInPandas(lifted, f"{cell}, __map string"), machine)
    else:
        guess = rows.select(*_CELL).distinct().withColumn("__entry", F.lit(json.dumps(machine.start)))
    known, todo = None, materialise(guess, "entries")
    while True:
        ran = dealt(rows.join(todo, list(_CELL))).mapInPandas(exits, f"{cell}, __entry string, __exit string")
        if known is not None:
            ran = known.join(todo.select(*_CELL), list(_CELL), "left_anti").unionByName(ran)
        known = materialise(ran, "exits")
        before = F.lag("__exit", 1, json.dumps(machine.start)).over(Window.partitionBy("__key").orderBy("__bucket"))  # a row a bucket
        todo = materialise(known.withColumn("__was", before).where("__was <> __entry").select(*_CELL, F.col("__was").alias("__entry")), "entries")
        if todo.isEmpty():
            return dealt(rows.join(known.select(*_CELL, "__entry"), list(_CELL))).mapInPandas(final, _schema(df, machine, key, order))


def _entries_composed(whole: DataFrame, machine: Machine) -> DataFrame:
    """Entry states of every bucket from the buckets' composed maps: a row a bucket, a key's in order."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, made in zip(batch["__key"].tolist(), batch["__map"].tolist(), strict=True):
                if k != key:
                    key, state = k, machine.start
                out.append(json.dumps(state))
                state = machine.act(tuple(json.loads(made)), state)
            yield pd.DataFrame({"__key": batch["__key"].astype(object), "__bucket": batch["__bucket"], "__entry": pd.Series(out, dtype=object)})

    return whole.repartition("__key").sortWithinPartitions(*_CELL).mapInPandas(entries, "__key string, __bucket bigint, __entry string")


def first_available(**candidates: Column) -> tuple[Column, Column]:
    """The first candidate that is not null, and its name."""
    name = F
    for k, c in candidates.items():
        name = name.when(c.isNotNull(), k)
    return F.coalesce(*candidates.values()), name.otherwise(None)


def confident(df: DataFrame, confidence: str = "confidence", least: float = 0.30) -> DataFrame:
    """Rows of enough confidence."""
    return df.where(F.col(confidence) >= least)


def held_share(df: DataFrame, key: str) -> DataFrame:
    """For each key the share of fresh rows and the number of held ones."""
    return df.groupBy(key).agg(F.avg((F.col("state") == "fresh").cast("double")).alias("fresh"), F.count_if(F.col("state") == "held").alias("held"))


def session_audit(df: DataFrame, ts: str, session: str, run: str, clipped: Column, silent: Column, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """T13 with event time: runs and quality counts of each session and window; rows later than ``late`` are left out of a stream.

    On a table runs are counted exactly; on a stream, which cannot hold them all, by a sketch with a relative error of 5%.
    """
    runs = F.approx_count_distinct(run) if df.isStreaming else F.count_distinct(run)
    timed = df.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window).alias("w"), session).agg(F.count("*").alias("events"), runs.alias("runs"), F.count_if(clipped).alias("clipped"), F.count_if(silent).alias("silent")).select(F.col("w.start").alias("window_start"), session, "events", "runs", "clipped", "silent")


def stream_of_files(spark, path: str, schema: str, kind: str = "json", most: int = 1) -> DataFrame:
    """A landing folder as a stream; ``most`` files a micro-batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).format(kind).load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """K-S8: results of a stream as JSON files."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()
