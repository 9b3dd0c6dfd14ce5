"""Test corpora made from the driver's tables: artifacts are injected as a function of the id, alike in Spark and SQL.

The tables hold plain prose, so a repair of them would be a vacuous no-op; a sample chosen by the id is added to
each whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.rewrite import quote


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(samples: tuple[str, ...], key: str = "doc_id") -> Column:
    return F.element_at(F.array(*map(F.lit, samples)), (F.pmod(F.col(key), F.lit(len(samples))) + 1).cast("int"))


def pick_sql(samples: tuple[str, ...], key: str = "doc_id") -> str:
    shown = ", ".join("chr(0)".join(quote(p) for p in s.split("\x00")) if "\x00" not in s else "concat(" + ", chr(0), ".join(quote(p) for p in s.split("\x00")) + ")" for s in samples)
    return f"list_extract([{shown}], ({key} % {len(samples)} + 1)::INT)"


def with_samples(spark: SparkSession, sf_dir: str, *samples: str) -> DataFrame:
    """``(doc_id, text)``: each whole text, a line break, and one sample."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(samples)).alias("text"))


def with_samples_sql(*samples: str) -> str:
    return f"(SELECT doc_id, concat(coalesce(text, ''), chr(10), {pick_sql(samples)}) AS text FROM documents)"
