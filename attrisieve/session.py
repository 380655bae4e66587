"""Session factory with the settings every module of the engine assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings results depend on (time zone, ANSI) and settings large inputs need (AQE with skew handling).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str | None = None, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("attrisieve")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the fixture folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a temporary one only in a local session without."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attrisieve-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder
