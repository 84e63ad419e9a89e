"""Numbers and neighbours in a stated order.

Windows are partitioned by the key they number within. Where the reference numbers a whole
table, ``dense_ids`` does so without putting it into one partition.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.sources.shared import written


def dense_ids(df: DataFrame, order: list[str], name: str = "docid") -> DataFrame:
    """1..n in the order of the columns: range partitions are written sorted, and each is shifted by
    the rows before it. Only one count for each partition comes together. Bounds of ranges are sampled anew
    by every plan that reads them, so rows and counts must come from what was written once."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    shift = marked.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    return marked.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift")


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """The sum of ``value`` over all rows before each in the order of the columns, over the whole table: range partitions are
    written sorted, each sums its own rows, and only their totals come together. Rows alike in order stand in any order."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    shift = rows.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_part", "_at", "_shift")


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """How often a key has stood so far, this row included."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def neighbours(df: DataFrame, within: list[str], order: list[str], of: str) -> DataFrame:
    """previous_ and next_ of a column."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumns({f"previous_{of}": F.lag(of).over(w), f"next_{of}": F.lead(of).over(w)})


def run_starts(df: DataFrame, within: list[str], order: list[str], group: str) -> DataFrame:
    """Whether a row begins a new run of ``group``, and the run's number."""
    w = Window.partitionBy(*within).orderBy(*order)
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = ~F.lag(group).over(w).eqNullSafe(F.col(group)) | (F.row_number().over(w) == 1)
    return df.withColumn("starts_run", starts).withColumn("run", F.sum(F.col("starts_run").cast("int")).over(rows))


def unsorted(df: DataFrame, within: list[str], line: str, keys: list[str]) -> DataFrame:
    """Lines whose key is smaller than that of the line before."""
    w = Window.partitionBy(*within).orderBy(line)
    key = F.struct(*keys)
    return df.withColumn("_before", F.lag(key).over(w)).where(F.col("_before") > key).drop("_before")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def positional_route(number: Column) -> Column:
    return F.format_string("%04d", number)
