"""The row-local operators over streams of documents, and counts by window of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions.fulltext import normalize
from vellum.functions.quality import quality
from vellum.sources.folders import work_path


def documents(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 100, pattern: str = "*") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def scored(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its quality; stateless, so late or repeated rows need nothing."""
    return stream.select(id_col, F.inline(F.array(quality(F.col(text_col)))))


def cleaned(stream: DataFrame, text_col: str = "text", level: str = "academic") -> DataFrame:
    return stream.withColumn(text_col, normalize(F.col(text_col), level))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, written to the shared folder with a checkpoint of its own, as a table."""
    spark = stream.sparkSession
    out = work_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def first_of_each(stream: DataFrame, time_col: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept only as long as rows may be late."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of each key in each window of arrival."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).count()
