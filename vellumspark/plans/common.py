"""Shared pieces of the queries: tables by name, and the stand-ins for a corpus's own tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the searchable representations of a catalogue."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("docid"), F.col("source").alias("collection_id"), F.col("doc_id").cast("string").alias("representation_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("representation_label"), F.col("text").alias("body"), F.col("lang").alias("language"),
    )


def capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the results of captures: a source for each user, a capture for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("capture_id"), (F.col("event_type") != "error").alias("ok"), F.col("event_type"), F.col("value"),
        F.date_format("ts", "yyyyMMdd").alias("day"),
    )


CAPTURES_SQL = """(select user_id as source_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || lpad(event_id::varchar, 12, '0') as capture_id,
  event_type <> 'error' as ok, event_type, value, strftime(ts, '%Y%m%d') as day from events)"""
