"""Line dedup over levelled, sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import materialise, sorted_run

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the task's contract: what is stripped from both ends of a line.
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """Lines between \\n; null and empty text have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """For each line 128 bits of its key, as a struct of two hashes; null where the key is shorter than ``min_chars``."""
    keys = lines_of(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(_BLANK))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("line_hash"), F.xxhash64(F.lit(1), key).alias("line_check")))

    return F.transform(keys, hashed)


_KEY = ("line_hash", "line_check")


class LineRuns:
    """Levelled runs of (line_hash, line_check, n_docs), bucketed by the hash and sorted in each bucket.

    A new batch's counts are anti-joined with the runs: lines that a run holds in
    ``enough`` documents already need no more counting. What is left becomes a run of
    level 0. Two runs of a level are merged into one of the next, so a line is rewritten
    about log2(batches) times. Anti-join and merge are sort-merge joins of tables that are
    bucketed alike, so neither shuffles. Batches must not share documents.
    """

    def __init__(self, spark: SparkSession, enough: int) -> None:
        self.spark, self.enough = spark, enough
        self.levels: list[DataFrame | None] = []

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (with the key's columns) that no run holds in ``enough`` documents yet."""
        for run in self.runs():
            lines = lines.join(run.where(F.col("n_docs") >= self.enough).select(*_KEY).hint("merge"), list(_KEY), "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch's (line_hash, line_check, doc_id) rows, one for each line or fewer."""
        once = lines.where("line_hash is not null").groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one"))
        run, level = sorted_run(self.new_lines(once.groupBy(*_KEY).agg(F.count("*").alias("n_docs"))), _KEY), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._merged(self.levels[level], run), None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    @staticmethod
    def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed("n_docs", "more")
        both = one.hint("merge").join(other, list(_KEY), "full_outer")
        return sorted_run(both.select(*_KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs")), _KEY)

    def at_least(self) -> DataFrame:
        """Keys that the runs together hold in ``enough`` documents or more; the runs become one."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "line_hash bigint, line_check bigint")
        whole = runs[0]
        for run in runs[1:]:
            whole = self._merged(whole, run)
        self.levels = [None] * (len(self.levels) - 1) + [whole]
        return whole.where(F.col("n_docs") >= self.enough).select(*_KEY)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, out: str = "line_dedup") -> DataFrame:
    """Drop every line whose key occurs in ``min_docs`` documents or more, everywhere.

    Returns all columns of ``docs`` (but one named ``out``) and, in ``out``, a struct of kept (the
    text that stays), n_lines and n_dropped. Documents are told apart by doc_id: rows that
    repeat an id count once. Batches of documents go to ``LineRuns`` one after the other; then the lines are held
    against the runs. Only hashes (128 bits a key) are exploded and shuffled; each text moves once, to meet its
    flags, and documents without a dropped line carry no flags. A line key in a
    third of all documents is counted by partial aggregates, and the join with
    the frequent keys has one row a key on its other side, so it can be split.
    Null text: one empty line, kept is "". A null doc_id is a document too.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*[c for c in docs.columns if c.lower() != out.lower()]).alias("row"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    marked = packed.select(F.col("__id").alias("doc_id"), F.xxhash64("__text").alias("text_hash"), line_hashes(F.col("__text"), min_chars).alias("hashes"))
    lines = materialise(
        marked.select("doc_id", "text_hash", F.posexplode("hashes").alias("pos", "key")).where("key is not null").select("doc_id", "text_hash", "pos", "key.*", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")),
        "lines",
        ("batch",),
    )
    runs = LineRuns(spark, min_docs)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select(*_KEY, "doc_id"))
    frequent = materialise(runs.at_least(), "frequent")
    dropped = lines.join(frequent, list(_KEY), "left_semi").groupBy(F.col("doc_id").alias("__fid"), F.col("text_hash").alias("__fhash")).agg(F.array_sort(F.collect_set("pos")).alias("__drop"))
    met = packed.withColumn("__hash", F.xxhash64("__text")).join(dropped, F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__hash") == F.col("__fhash")), "left")
    return met.select("row.*", _kept(F.col("__text"), F.col("__drop")).alias(out))


def _kept(text: Column, drop: Column) -> Column:
    """Struct of the text that stays once the lines at the sorted positions ``drop`` are gone, and the counts.

    What stays are the slices between neighbouring dropped positions, so the cost
    is linear in the lines however many go.
    """
    lines = lines_of(text)
    ends = F.concat(drop, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    pieces = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.slice(lines, r["s"] + 1, r["e"] - r["s"])))
    none = drop.isNull()
    return F.struct(
        F.when(none, F.coalesce(text, F.lit(""))).otherwise(F.array_join(pieces, "\n")).alias("kept"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.size(drop)).cast("bigint").alias("n_dropped"),
    )
