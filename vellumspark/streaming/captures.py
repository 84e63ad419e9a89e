"""Captures as a stream (an extension: the corpus tools that this engine follows are batch only).

Results of captures arrive as files; the best provider of each source is kept up to date.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.captures import best_provider

SCHEMA = "source_id string, capture_id string, ok boolean, ended_at timestamp"


def results(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def providers(stream: DataFrame) -> DataFrame:
    """One row for each source, in update mode; state grows with the sources, not with captures."""
    return best_provider(stream)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Captures and successes by hour of their end; what is later than ``late`` is left out."""
    return stream.withWatermark("ended_at", late).groupBy(F.window("ended_at", "1 hour")).agg(F.count("*").alias("captures"), F.count_if("ok").alias("fine"))
