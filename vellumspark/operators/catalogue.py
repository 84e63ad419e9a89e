"""The catalogue: document rows, summaries, projections, page lists and index lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import nfc
from vellumspark.functions.urls import cdx_timestamp, page_id, surt
from vellumspark.operators.numbering import dense_ids, first_by


def from_documents(docs: DataFrame) -> DataFrame:
    """Document rows of a catalogue with dense ids in the order of collection and representation.
    Digests replace bodies before rows are ordered, so texts are not moved."""
    rows = docs.select(
        F.col("source").alias("collection_id"), F.col("doc_id").alias("representation_id"), nfc(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("body_sha256"),
    )
    return dense_ids(rows, ["collection_id", "representation_id"])


def summary(documents: DataFrame) -> DataFrame:
    return documents.groupBy("collection_id").agg(F.count("*").alias("documents"), F.count_distinct("language").alias("languages"), F.sum("bytes").alias("bytes"))


def projection(collections: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each wanted collection: its items in order, or that it is unavailable."""
    listed = items.groupBy("collection_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("item_id", "label"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["item_id"], x["label"])), ",")
    out = collections.select("collection_id").distinct().join(listed, "collection_id", "left")
    return out.select("collection_id", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce(text, F.lit("")).alias("items"), F.when(F.col("n").isNull(), "unavailable").otherwise("available").alias("status"))


def pages(records: DataFrame) -> DataFrame:
    """A page for each (url, timestamp): its first record by file and offset, with an id."""
    return first_by(records, ["url", "timestamp"], ["filename", "offset"]).withColumn("id", page_id(F.col("url"), F.col("timestamp")))


def cdx_lines(records: DataFrame) -> DataFrame:
    """Index lines in order of key and time: key, 14 digits, and the facts as JSON with sorted names."""
    facts = F.to_json(F.struct("digest", "filename", "length", "mime", "offset", "status", "url"), {"ignoreNullFields": "false"})
    rows = records.select(surt(F.col("url")).alias("key"), cdx_timestamp(F.col("ts")).alias("stamp"), "filename", "offset", facts.alias("json"))
    return rows.orderBy("key", "stamp", "filename", "offset").select("key", "stamp", F.concat_ws(" ", "key", "stamp", "json").alias("line"))
