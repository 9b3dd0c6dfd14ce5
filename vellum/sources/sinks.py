"""Sinks: texts and sidecars of a run as tables of files, and the run's receipt."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.functions.fulltext import ACADEMIC, normalize, with_report
from vellum.functions.quality import quality

VERSION = "0.1.0"


#: Decoders that a PDF or Word plug-in may use.
ENGINES = ("pdfplumber", "pymupdf", "pypdf", "mammoth", "docx", "lxml", "bs4")


def revision() -> str | None:
    """The commit of the checkout that this package is in; None outside one."""
    root = Path(__file__).resolve().parents[2] / ".git"
    try:
        head = (root / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        ref = head.removeprefix("ref: ")
        if (root / ref).exists():
            return (root / ref).read_text().strip()
        return next((l.split()[0] for l in (root / "packed-refs").read_text().splitlines() if l.endswith(" " + ref)), None)
    except OSError:
        return None


def versions(spark: SparkSession) -> DataFrame:
    """One row: the engine's version and commit, Spark's and PySpark's version, and which decoders are installed."""
    there = {e: importlib.util.find_spec(e) is not None for e in ENGINES}
    return spark.createDataFrame([(VERSION, revision(), spark.version, pyspark.__version__, there)], "engine string, commit string, spark string, pyspark string, decoders map<string,boolean>")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: str = ACADEMIC) -> DataFrame:
    """``docs`` normalized, with quality, the report, and ``error`` for rows without text; nothing raises."""
    out = with_report(docs.select(id_col, F.col(text_col).alias("text")), "text", level)
    return out.withColumn("quality", quality(F.col("text"))).withColumn("error", F.when(F.col("text").isNull(), "no text"))


def sidecar() -> Column:
    """What is known of a row besides its text, as JSON."""
    return F.to_json(F.struct("quality", "report", "error"))


def extract_to_dir(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: str = ACADEMIC) -> DataFrame:
    """Write ``texts`` and ``sidecars`` below ``folder``, return the receipt; its totals are observed while the extraction is written."""
    spark, seen = docs.sparkSession, Observation()
    out = extract(docs, id_col, text_col, level).select(id_col, "text", sidecar().alias("sidecar"), "error", F.col("quality.score").alias("score"))
    out.observe(seen, *totals()).write.mode("overwrite").parquet(f"{folder}/extracted")
    done = spark.read.parquet(f"{folder}/extracted")
    done.select(F.to_json(F.struct(id_col, "text")).alias("value")).write.mode("overwrite").text(f"{folder}/texts")
    done.select("sidecar").write.mode("overwrite").text(f"{folder}/sidecars")
    got = seen.get
    return spark.createDataFrame([tuple(got[n] for n in ("n_total", "n_ok", "n_failed", "mean_score"))], "n_total long, n_ok long, n_failed long, mean_score double")


def totals() -> tuple[Column, ...]:
    return F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.round(F.avg("score"), 4).alias("mean_score")


def receipt(done: DataFrame) -> DataFrame:
    """Totals of a run: rows, good ones, failures, mean quality."""
    return done.agg(*totals())


def write_rows(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(folder)


def write_tables(tables: DataFrame, folder: str, key: str = "table_id") -> None:
    """One folder for each table's HTML; for few tables, as each is a file."""
    tables.select(key, "html").write.mode("overwrite").partitionBy(key).text(folder)


def normalize_column(docs: DataFrame, text_col: str = "text", level: str = ACADEMIC) -> DataFrame:
    return docs.withColumn(text_col, normalize(F.col(text_col), level))
