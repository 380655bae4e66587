"""Reading tables, cutting lineage and finding the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; an own one only in a local session that names none."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attrisieve-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Checkpoints after which the driver is asked to collect its garbage.
COLLECT_AFTER = 4
_written = [0]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder now and go on from the copy, so a lost executor costs no recomputation.

    Spark deletes shuffle files, and checkpoints where it is told to, when the driver collects what refers to them. In a
    plan of many rounds over small tables that can take long, so it is asked to every few checkpoints.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    _written[0] += 1
    if _written[0] % COLLECT_AFTER == 0:
        gc.collect()
        spark._jvm.System.gc()
    return kept


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def own_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns an operator reads, under its own names, so extra columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in wanted.items()])


def distinct(values):
    """The different values of an array, in order. Sorting is many times faster than numpy's unique, which hashes."""
    import numpy as np

    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Record batches of at most so many rows, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return what a task has freed to the system: the worker process outlives it and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """What run yields, and then give_back()."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like the wanted one that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken or f"{wanted}_".lower() in taken:
        wanted += "_"
    return wanted
