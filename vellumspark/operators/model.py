"""Checks of an access graph that is kept as tables: unique ids, references, facets and limits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The most rows that one collection's graph may have.
LIMITS = {"items": 2_000, "artifacts": 4_000, "inline_segments": 100_000, "external_segments": 500_000}
MAX_FACETS, MAX_FACET_VALUES = 32, 128


def one_namespace(*tables: DataFrame) -> DataFrame:
    """Ids that are used more than once over all tables (column id)."""
    ids = tables[0].select("id")
    for t in tables[1:]:
        ids = ids.unionByName(t.select("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str = "id") -> DataFrame:
    """References without a target; null refers to nothing and is fine."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)), ref, "left_anti")


def bad_relations(relations: DataFrame, *endpoints: DataFrame) -> DataFrame:
    """Relations with an end that is no collection, item, representation or inline segment."""
    ids = endpoints[0].select("id")
    for t in endpoints[1:]:
        ids = ids.unionByName(t.select("id"))
    ids = ids.distinct()
    bad = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return bad.unionByName(relations.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(*bad.columns)).distinct()


def facet_conflicts(facets: DataFrame) -> DataFrame:
    """Facet keys with several labels or notes over all items; a missing note is a note of its own."""
    n = facets.groupBy("key").agg(F.count_distinct("label").alias("labels"), F.count_distinct(F.coalesce(F.concat(F.lit("="), "note"), F.lit(""))).alias("notes"))
    return n.where("labels > 1 or notes > 1")


def facet_notes(facets: DataFrame) -> DataFrame:
    """The first note of each key, by the facets' order."""
    return facets.where("note is not null").groupBy("key").agg(F.min_by("note", "ordinal").alias("note"))


def facet_valid(values):
    """Whether a facet's values are 1 to 128, distinct, trimmed and free of control characters."""
    good = F.forall(values, lambda v: (F.length(v) > 0) & (F.trim(v) == v) & ~v.rlike(r"\p{Cc}"))
    return F.size(values).between(1, MAX_FACET_VALUES) & (F.size(F.array_distinct(values)) == F.size(values)) & good


def over_limits(counts: DataFrame) -> DataFrame:
    """Rows (collection_id, what, n) over the limit of their kind."""
    limit = F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))])
    return counts.where(F.col("n") > F.try_element_at(limit, F.col("what")))


def numbered(df: DataFrame, values: str, name: str) -> DataFrame:
    """An array's elements as rows with their ordinal."""
    rest = [c for c in df.columns if c != values]
    return df.select(*rest, F.posexplode(values).alias("ordinal", name))
