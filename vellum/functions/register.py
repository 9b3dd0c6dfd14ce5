"""The text operators as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from vellum.operators import captions, render, repairs, sections
from vellum.operators.references import repair_text


def register(spark: SparkSession) -> list[str]:
    """Register ``sections``, ``captions``, ``repair_glyphs``, ``repair_references`` and ``finish_markdown``; their names."""

    def series(f):
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return run

    made = {
        "sections": (sections.sections_of, ArrayType(sections.SECTION)),
        "captions": (captions.captions_of, ArrayType(captions.CAPTION)),
        "repair_glyphs": (repairs.repair_text, StringType()),
        "repair_references": (repair_text, StringType()),
        "finish_markdown": (render.finish_text, StringType()),
    }
    for name, (f, kind) in made.items():
        spark.udf.register(name, F.pandas_udf(series(f), kind))
    return list(made)
