"""The contract's queries: thin views of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ann import search
from tessera.llm.bpe import encode_decode
from tessera.llm.embdedup import near_duplicate_vectors
from tessera.llm.exactdedup import exact_duplicates
from tessera.llm.html import extract_text
from tessera.llm.langid import fit, identify, is_held_out
from tessera.llm.linededup import dedup_lines
from tessera.llm.manifest import merkle_manifest
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_sources
from tessera.llm.periodic import periodic_runs
from tessera.llm.pii import KINDS, find_personal_data, span_list
from tessera.llm.sharding import shard_documents


#: The vocabulary of op6, as the contract names it.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"pii.{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = F.array_sort(F.concat(*[F.transform(f"pii.{k}", lambda s: F.struct(s["start"], s["kind"], s["end"])) for k in KINDS]))
    return found.select("doc_id", *counts, F.sha2(F.encode(span_list(base), "UTF-8"), 256).alias("base_sha256"), span_list(F.col("pii.spans")).alias("spans"), "pii.n_added", span_list(F.col("pii.secrets")).alias("secrets"), (F.size("pii.spans") + F.size("pii.secrets")).cast("bigint").alias("n_spans"))


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.encode("line_dedup.kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _id_hash() -> Column:
    """Unsigned crc32 of the decimal doc_id, which decides what the contract changes in a text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    shown = F.when(_id_hash() % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return merkle_manifest(_table(spark, sf_dir, "documents"), shown)


def _with_repeats(text: Column) -> Column:
    """The contract's texts: of every tenth document the words from some place on are a period's repetition."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(_id_hash() / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, (F.ceil((n - a) / p)).cast("int"))), F.lit(1), n - a)
    return F.when((_id_hash() % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _with_repeats(F.col("text")).alias("text"))
    found = periodic_runs(docs, least=24, times=3)
    written = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.reduce("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    named = found.withColumn("best", best)
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint")
    return named.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(written.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_mix_sources": op2_mix_sources,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_pii": op4_pii,
        "op5_shard_documents": op5_shard_documents,
        "op6_bpe": op6_bpe,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_html_text": op8_html_text,
        "op9_line_dedup": op9_line_dedup,
        "op10_ann": op10_ann,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_periodic_runs": op13_periodic_runs,
    }
