"""The bounded sample of labelled documents that the classifiers are fitted on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm._store import materialize

#: At most so many labelled documents, the first by a hash of their id.
SAMPLE_ROWS = 4000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label, and n_chars if there is one) of at most ``rows`` labelled ids that are not held out. The label of an id
    with several is the largest; ids or labels that are null, and ids that are held out, teach
    nothing. The ids are at most ``rows``, so that side may be broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = ["text", *(c for c in ("n_chars",) if c in docs.columns)]
    return materialize(docs.select("doc_id", *own).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select(*own, "label"))
