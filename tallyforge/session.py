"""Session settings that the operators assume: UTC, ANSI dates, adaptive execution."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir; where it is unset, one below the warehouse, or on a local master a temporary one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="checkpoints-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores, where a table has fewer files than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def session(name: str = "tallyforge", **settings: str) -> SparkSession:
    """A session with these settings; others by keyword, dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
