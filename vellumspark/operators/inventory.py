"""Expected against observed: fixity, lineage and completeness as joins.

All of these shuffle on the compared key alone and carry no more columns than they compare.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: sha256 of no bytes, the digest of directories.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def fixity_diff(expected: DataFrame, actual: DataFrame, key: str = "path", fields: tuple = ("type", "size", "sha256")) -> DataFrame:
    """key, problem (missing, unexpected or mismatch) and field, one row for each difference.
    Fields are compared in the given order, nulls as values."""
    e = expected.select(F.col(key), F.struct(*fields).alias("e"))
    a = actual.select(F.col(key), F.struct(*fields).alias("a"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    found = F.when(F.col("a").isNull(), F.array(F.struct(F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("field"))))
    found = found.when(F.col("e").isNull(), F.array(F.struct(F.lit("unexpected").alias("problem"), F.lit(None).cast("string").alias("field"))))
    found = found.otherwise(F.transform(wrong, lambda f: F.struct(F.lit("mismatch").alias("problem"), f.alias("field"))))
    return e.join(a, key, "full_outer").select(key, F.inline(found))


def nullable_mismatch(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Facts that are stated and differ; an expected null is no statement. Missing rows are reported too."""
    a = actual.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    wrong = [F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]
    problem = F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*wrong)))
    return expected.join(a, key, "left").select(key, F.explode(problem).alias("problem"))


def gaps(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key and side: missing (expected only) or unexpected (observed only), each id once."""
    e, o = expected.select(key).distinct(), observed.select(key).distinct()
    return e.join(o, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(o.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))


def same_members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether two lists have no repeats and the same members."""
    counts = left.groupBy(key).count().withColumnRenamed("count", "l").join(right.groupBy(key).count().withColumnRenamed("count", "r"), key, "full_outer")
    return counts.agg(F.coalesce(F.bool_and((F.coalesce("l", F.lit(0)) == 1) & (F.coalesce("r", F.lit(0)) == 1)), F.lit(True)).alias("same"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def in_several(df: DataFrame, member: str, package: str) -> DataFrame:
    """Members found in more than one package, and the packages in order."""
    return df.groupBy(member).agg(F.sort_array(F.collect_set(package)).alias("packages")).where(F.size("packages") > 1)


def missing_representations(items: DataFrame, captured: DataFrame, kinds: DataFrame, exempt: DataFrame, exempt_kind: str = "translation") -> DataFrame:
    """(item, kind) that is required and not captured; exempt items need no ``exempt_kind``.
    Items and kinds are crossed, as every item needs each of the few kinds."""
    need = items.select("item").distinct().crossJoin(F.broadcast(kinds.select("kind").distinct()))
    spared = exempt.select("item").distinct().withColumn("kind", F.lit(exempt_kind))
    return need.join(spared, ["item", "kind"], "left_anti").join(captured.select("item", "kind"), ["item", "kind"], "left_anti")


def with_default(expected: DataFrame, found: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """The found value of every expected key, else a default."""
    return expected.join(found.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def reviewed_ids(observed: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Ids through a reviewed mapping (key, mapped); an id that it lacks stands for itself."""
    return observed.join(mapping, key, "left").withColumn("resolved", F.coalesce("mapped", F.col(key))).drop("mapped")


def ordered_digest(df: DataFrame, column: str) -> str:
    """sha256 of the distinct values in order, a line each. Values are sorted by the cluster and
    hashed as they stream in, so the driver holds one partition at a time."""
    import hashlib

    h, any_ = hashlib.sha256(), False
    for row in df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").toLocalIterator():
        h.update(("\n" if any_ else "").encode() + row["v"].encode())
        any_ = True
    h.update(b"\n")
    return h.hexdigest()


def directory_entry(kind: Column, size: Column, digest: Column) -> tuple[Column, Column]:
    """Size and digest of an object: directories have none of either."""
    return F.when(kind == "directory", 0).otherwise(size), F.when(kind == "directory", EMPTY_SHA256).otherwise(digest)
