"""Connected components of a graph of any size, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm._store import discard, materialize, shared_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has a link.

    ``edges`` has columns u and v. Large stars hang each node's larger neighbours under its
    smallest one, small stars do so for the smaller neighbours, until nothing changes; rounds
    grow with the logarithm of the number of nodes. Minima are aggregated before they are joined
    and every round is written to the shared folder, so lineage stays short."""
    spark, paths = edges.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        return materialize(df, paths[-1])

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = keep(ordered(edges))  # u > v
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(ordered(large))
        least = keep(e.groupBy("u").agg(F.min("v").alias("m")))
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = keep(ordered(small))
        after = _state(e)
        for p in paths[:-1]:
            discard(spark, p)
        del paths[:-1]
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
