"""A corpus cleaned in five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last
returns what encoding makes of them.

Cases, for every stage: columns beside those of ``documents`` are left out, so that none can clash; a
null source, lang or n_chars passes through (n_chars is counted anew where a text is); rows are treated one
by one however often they are repeated; texts are read whole, whatever their length; an empty table gives
an empty table with the same columns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import containment, line_rules, queries, simhash_trie, substring_index
from vellumspark.llm._store import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines leave the texts, rejected documents go. A null or empty text has too few words and goes; a
    null id doesn't matter; equal rows have equal verdicts."""
    out = line_rules.judge(docs.select(*COLUMNS)).where("kept")
    clean = F.when(F.col("lost_chars") > 0, F.col("clean_text")).otherwise(F.col("text"))
    return out.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity of at least 0.8), the
    document with the smallest id stays. Rows are told apart by their place, so null and repeated ids
    keep or remove nothing else."""
    return simhash_trie.near_duplicates(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; texts without any stay as they are, null ones too. A null id
    ranks last; rows with one id, or none, never cut each other, so ties are kept."""
    out = substring_index.dedup(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("changed"), F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, a null or empty text never does. A text decides for itself: rows whose
    id is null or repeated are told apart by their texts' digests, and equal texts go or stay together."""
    mark = F.sha2("text", 256)
    found = containment.search(docs.select(mark.alias("doc_id"), "text"), queries.table(spark, sf_dir, "benchmark"))
    leaks = materialize(found.select(F.col("doc_id").alias("_mark")).distinct())
    return docs.join(leaks, mark == F.col("_mark"), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them, as digests: a row for each document, null ids too. A null text
    counts as empty, which has no ids."""
    return queries.encoded(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", encode)]

#: SQL can't express the tries of stage 2 or the merges of stage 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k + 1 == len(STAGES) else materialize(docs)
    return docs
