"""From documents to tokens: five stages, each one of the operators in tessera.llm."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_decode
from tessera.llm.langid import fit, identify
from tessera.llm.linededup import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_sources
from tessera.llm.queries import VOCABULARY
from tessera.plans import settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what lies too far from every centroid goes.

    The model learns from these documents' own labels. Null and letterless texts go.
    """
    found = identify(docs.withColumn("__row", F.struct("*")).select("__row", F.col("text")), fit(docs))
    return found.where("language.accepted").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that ten or more of them share; n_chars follows the text."""
    out = "__lines"
    while out in docs.columns:  # a name that the documents do not have
        out += "_"
    kept = dedup_lines(docs, min_docs=10, out=out)
    text = F.when(F.col("text").isNotNull(), F.col(f"{out}.kept"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) and of each doc_id; null ids stay."""
    kept = near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source", "lang"), "text", "source", "lang")  # rows of one id
    named = docs.join(kept, "doc_id", "left_semi").withColumn("__turn", F.row_number().over(order)).where("__turn = 1")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, which may be never."""
    repeats = mix_sources(docs).groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source")).agg(F.max("repeats").alias("__repeats")).where("__repeats > 0")
    met = docs.join(repeats, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")))
    return met.withColumn("__turn", F.explode(F.array_repeat(F.lit(0), F.col("__repeats").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers) and digests of ids and decoded text."""
    coded = encode_decode(docs, VOCABULARY)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("mix", mix),
    ("tokens", tokens),
]

#: Centroids, signatures and merges are beyond SQL; a test holds every stage against plain Python on a small table.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, functools.partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
