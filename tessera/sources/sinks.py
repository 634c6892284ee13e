"""Sinks: tables, JSON documents, line logs, vector tables, text and HTML reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import html_escape, nan_to_null


def write_csv(df: DataFrame, path: str) -> None:
    """K-S1: CSV with a header; arrays as JSON text."""
    texts = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    df.withColumns(texts).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """K-S1: Parquet, the default for anything that is read again."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def as_documents(df: DataFrame, name: str = "document") -> DataFrame:
    """K-S2: each row as JSON text, NaN as null, null fields kept."""
    return nan_to_null(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def append_lines(df: DataFrame, path: str) -> None:
    """K-S3: rows appended as JSON lines."""
    df.write.mode("append").json(path)


def upsert_vectors(spark, change: DataFrame, path: str, key: str, version: int, reset: bool = False) -> DataFrame:
    """K-S5: the vector table of ``version`` = the one before with ``change`` added or put in place by key; only ``change`` on reset.

    Versions are folders, so a reader of the old one is not disturbed and a failed write leaves it whole.
    """
    from tessera.operators.retrieve import upsert

    after = change if reset or version == 0 else upsert(spark.read.parquet(f"{path}/v{version - 1}"), change, key)
    after.write.mode("overwrite").parquet(f"{path}/v{version}")
    return spark.read.parquet(f"{path}/v{version}")


def html_rows(df: DataFrame) -> DataFrame:
    """K-S4: each row as a row of an HTML table, escaped."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit("–"))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def html_report(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """K-S4, K-S6: one page with a card for each summary table; summaries only, ``most`` rows each at the most."""
    cards = []
    for name, df in tables.items():
        head = "".join(f"<th>{c}</th>" for c in df.columns)
        body = "".join(r.row for r in html_rows(df).limit(most).collect())
        cards.append(f"<section><h2>{name}</h2><table><tr>{head}</tr>{body}</table></section>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1>{''.join(cards)}</body></html>"


def channel_frame(df: DataFrame, frame: str, channel: str, value: str, channels: list[int]) -> DataFrame:
    """K-S9, P15: samples on one channel as wide rows, silence on the others."""
    return df.groupBy(frame).pivot(channel, channels).agg(F.first(value)).fillna(0.0)
