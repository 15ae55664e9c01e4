"""Session defaults, and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("geostrata").config(map=DEFAULTS | conf)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder of spark.checkpoint.dir. Where that is unset a temporary folder serves, on one machine only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="geostrata-checkpoint-")
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: later steps neither repeat it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks can run at once. An input of enough files, or one that has been shuffled, stays as it is and nothing moves."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
