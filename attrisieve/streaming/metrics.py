"""Run metrics kept up to date from a stream of events, as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_metrics(events: DataFrame) -> DataFrame:
    """(run_id, metric, value, step): the last value of each metric; state is a row per run and metric."""
    step = F.struct("ts", "event_id")
    return events.where("value is not null").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric")).agg(F.max_by("value", step).alias("value"), F.max("ts").alias("step"))


def windowed_metrics(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, metric, n, mean) per window; rows later than the watermark are dropped, as a stream must."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "metric", "n", "mean")


def run_available(spark: SparkSession, source: str, build, name: str, checkpoint: str, mode: str = "complete", repeat: int = 1) -> DataFrame:
    """Drive a streaming plan over the parquet files there now; what it finds is written beside its checkpoint and read from there.

    In append mode every batch has a folder named by its number, so a batch that is run again after a failure replaces what
    it had written and counts once. repeat writes each batch so many times, as restarts would.
    """
    schema = spark.read.parquet(source).schema
    folder, _, file = source.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    path = f"{checkpoint.rstrip('/')}-{name}"

    def keep(found: DataFrame, batch: int) -> None:
        for _ in range(repeat):
            found.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch}")

    query = build(stream).writeStream.outputMode(mode).foreachBatch(keep).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
