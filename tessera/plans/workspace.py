"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: set[tuple[str, str]] = set()
#: Names in the catalog of the runs among them, by path.
_TABLES: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master only.

    Elsewhere every executor would write to a disk of its own, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, megabytes: int = 2) -> None:
    """Bound the Arrow batches of this session's Python stages by bytes: texts and sets can be long, and a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > megabytes << 20:
        spark.conf.set(name, megabytes << 20)


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.add((spark.sparkContext.applicationId, path))
    return path


def materialise(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends, sizes are known, a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, per_task: int) -> DataFrame:
    """``df`` dealt evenly to tasks of about ``per_task`` rows: short rows that each are much work fill one file's split, and adaptive execution would join tasks by their bytes."""
    return df.repartition(max(1, -(-df.count() // per_task)))


def sorted_run(df: DataFrame, keys: tuple[str, ...], name: str = "run") -> DataFrame:
    """Write ``df`` once, in as many buckets of ``keys`` as the session shuffles to, each sorted by them.

    Tables so written meet on ``keys`` bucket by bucket, without a shuffle. A frame that comes out of
    an aggregate by ``keys`` is not shuffled again either. The table's files lie in the shared folder.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"tessera_{uuid.uuid4().hex}"
    first, *rest = keys
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), first, *rest).sortBy(first, *rest).option("path", path).saveAsTable(table)
    _TABLES[path] = table
    return spark.table(table)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``materialise`` what ``build`` returns, then drop the intermediate tables that it wrote on the way."""
    before = set(_WRITTEN)
    df = build()
    during = set(_WRITTEN) - before
    out = materialise(df, name)
    _drop(spark, during)
    return out


def _drop(spark: SparkSession, tables: set[tuple[str, str]]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for app, path in tables:
        if app == spark.sparkContext.applicationId:
            if path in _TABLES:
                spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        _WRITTEN.discard((app, path))


def release() -> None:
    """Remove this application's intermediate tables."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        _drop(spark, set(_WRITTEN))
    except Exception as gone:  # the JVM has ended before this hook ran: the folder is left to its owner
        print(f"tessera: intermediate tables were left behind ({type(gone).__name__})")
