"""``python -m vellum.cli extract|sections|render IN OUT`` over Parquet tables of ``(doc_id, text)``; ``--version``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.operators import render, sections
from vellum.sources import sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    p.add_argument("--version", action="version", version=sinks.VERSION)
    p.add_argument("command", choices=("extract", "sections", "render"))
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--level", choices=("none", "standard", "academic"), default="academic")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = spark.read.parquet(a.source).select("doc_id", "text")
    if a.command == "extract":
        sinks.extract_to_dir(docs, a.target, level=a.level).show()
    elif a.command == "sections":
        sections.section_rows(sinks.normalize_column(docs, level=a.level)).write.mode("overwrite").parquet(a.target)
    else:
        d = sinks.normalize_column(docs, level=a.level).withColumn("found", sections.sections(F.col("text")))
        made = render.finish(render.markdown(F.col("doc_id").cast("string"), F.col("found"), F.col("text")))
        d.select("doc_id", made.alias("markdown")).write.mode("overwrite").parquet(a.target)


if __name__ == "__main__":
    main()
