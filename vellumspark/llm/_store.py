"""Tables in the folder that driver and executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, a new subfolder for each call. Without one, a session of
    one machine takes a local folder; on a cluster that would lose rows, so it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = FALLBACK
    return f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and a lost executor
    costs no recomputation of what came before. What nobody discards goes with the driver."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator, so that those which its result does not read can go at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        out = materialize(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            discard(self.spark, path)


def steady(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions each time they are read: scans are, and what an exchange
    or a Python worker makes is written first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df) if any(x in plan for x in ("Exchange", "Python", "InArrow", "InPandas", "Sample", "Generate")) else df
