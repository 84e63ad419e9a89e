"""Folds over captures and their sources: which to use, and what their statuses add up to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_provider(results: DataFrame, source: str = "source_id", capture: str = "capture_id", ok: str = "ok") -> DataFrame:
    """The capture to use for each source: successes before others, then the latest id. One
    aggregation with map-side partials, no sort."""
    best = F.max_by(F.struct(F.col(capture), F.col(ok)), F.struct(F.col(ok).cast("int"), F.col(capture)))
    return results.groupBy(source).agg(best.alias("b")).select(source, F.col(f"b.{capture}").alias(capture), F.col(f"b.{ok}").alias(ok))


def contributing(best: DataFrame, capture: str = "capture_id") -> DataFrame:
    """The captures used, each once, and whether it is the primary (latest) one."""
    used = best.select(capture).distinct()
    last = used.agg(F.max(capture).alias("_last"))
    return used.crossJoin(F.broadcast(last)).select(capture, (F.col(capture) == F.col("_last")).alias("is_primary"))  # one row


def conflicting_directories(captures: DataFrame) -> DataFrame:
    """Capture ids that come from several directories."""
    return captures.groupBy("capture_id").agg(F.count_distinct("directory").alias("n")).where("n > 1")


# Statuses that count as success.
SUCCESS = ["complete", "complete_with_warnings"]


def source_status(failed_codes: Column, payload: Column, warnings: Column) -> Column:
    """Of one source: without failed exit codes complete if anything was kept, with warnings if
    there are any; with failed codes partial if anything was kept; else failed."""
    fine = F.when(warnings > 0, "complete_with_warnings").otherwise("complete")
    return F.when(payload & (failed_codes == 0), fine).when(payload, "partial").otherwise("failed")


def has_payload(mirror_files: Column, warc_evidence: Column, old_files: Column, old_bytes: Column) -> Column:
    """Whether a result kept anything: mirrored files or proven web records; results of the first
    schema have only counters of downloads."""
    new = mirror_files.isNotNull() | warc_evidence.isNotNull()
    return F.when(new, (F.coalesce(mirror_files, F.lit(0)) > 0) | F.coalesce(warc_evidence, F.lit(False))).otherwise((F.coalesce(old_files, F.lit(0)) > 0) | (F.coalesce(old_bytes, F.lit(0)) > 0))


def warc_evidence(containers: Column, indexed: Column, probed: Column) -> Column:
    """Whether web records are proven: by the index where its count is known, else by a probe."""
    return F.when(indexed.isNotNull(), (containers > 0) & (indexed > 0)).otherwise((containers > 0) & F.coalesce(probed, F.lit(False)))


def capture_status(results: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Status of each capture from its sources' status, required and payload columns. Failures of
    required sources dominate: partial if one of them is partial or anything was kept, else failed.
    Otherwise anything short of complete leaves warnings."""
    missed = F.col("required") & ~F.col("status").isin(SUCCESS)
    some = F.bool_or(missed & (F.col("status") == "partial")) | F.bool_or(F.coalesce("payload", F.lit(False)))
    status = F.when(F.bool_or(missed), F.when(some, "partial").otherwise("failed")).when(F.bool_or(F.col("status") != "complete"), "complete_with_warnings").otherwise("complete")
    return results.groupBy(capture).agg(status.alias("status"))


def view_status(statuses: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each of the keys: complete if all of a view's sources are, with warnings if all succeeded, else partial."""
    every, fine = F.bool_and(F.col("status") == "complete"), F.bool_and(F.col("status").isin(SUCCESS))
    return statuses.groupBy(*keys).agg(F.when(every, "complete").when(fine, "complete_with_warnings").otherwise("partial").alias("status"))


def report_status(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "incomplete").when(warnings > 0, "complete_with_warnings").otherwise("complete")


def complete_full(results: DataFrame, configured: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Captures whose sources are exactly the configured ones, each once and complete."""
    n = configured.select("source_id").distinct().count()
    known = results.join(F.broadcast(configured.select("source_id").distinct().withColumn("_known", F.lit(True))), "source_id", "left")
    agg = known.groupBy(capture).agg(F.count("*").alias("rows"), F.count_distinct("source_id").alias("kinds"), F.bool_and(F.coalesce("_known", F.lit(False)) & (F.col("status") == "complete")).alias("fine"))
    return agg.select(capture, (F.col("fine") & (F.col("rows") == n) & (F.col("kinds") == n)).alias("complete_full"))


def payload_metrics(files: DataFrame, *keys: str) -> DataFrame:
    """Files, bytes, WARC files and empty files of each group."""
    warc = F.lower("path").rlike(r"\.warc(\.gz)?$")
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(warc).alias("warc_files"), F.count_if(F.col("size") == 0).alias("empty_files"))


def quota_left(used: DataFrame, quota: int) -> DataFrame:
    return used.agg(F.greatest(F.lit(0), F.lit(quota) - F.coalesce(F.sum("size"), F.lit(0))).alias("left"))


def running(captures: DataFrame) -> DataFrame:
    return captures.agg(F.count_if(F.col("status") == "running").alias("running"))


def oxum(files: DataFrame, *keys: str) -> DataFrame:
    """Payload size and count as bytes.count."""
    return files.groupBy(*keys).agg(F.concat_ws(".", F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).alias("oxum"))


def lifecycle(collections: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """A row for each collection and a status for each dimension, ``absent`` where it has none.
    Each dimension is a DataFrame of collection_id and status; there is no overall verdict."""
    out = collections.select("collection_id")
    for name, df in dimensions.items():
        out = out.join(df.select("collection_id", F.col("status").alias(name)), "collection_id", "left").fillna("absent", [name])
    return out


def environment(checks: DataFrame) -> DataFrame:
    """One row: whether all checks (name, ok, detail) are fine, and the names of those that are not."""
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ", ").alias("failed"))
