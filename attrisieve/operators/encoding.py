"""The boundary to text and image encoders: a function from a list of inputs to vectors, called a batch at a time.

The stand-in needs no model: it hashes words, or bytes of a file, into signed counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import free_name
from ..functions.vectors import dot
from ..session import shared_dir

Encoder = Callable[[list], list]
DIM, BATCH = 64, 256


def stand_in(inputs: list) -> list[list[float]]:
    out = []
    for x in inputs:
        v = [0.0] * DIM
        for part in x.split() if isinstance(x, str) else (x[i : i + 8] for i in range(0, len(x), 8)):
            h = zlib.crc32(part.encode() if isinstance(part, str) else part)
            v[h % DIM] += 1.0 if h & 0x8000 else -1.0
        out.append(v)
    return out


def encode(rows: DataFrame, column: str, encoder: Encoder = stand_in, batch: int = BATCH, name: str = "v") -> DataFrame:
    """rows with column name, the vector of a text or of a file's bytes; null stays null. An encoder sees so many inputs at most."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            known = [i for i, x in enumerate(values) if x is not None]
            out: list = [None] * len(values)
            for at in range(0, len(known), batch):
                places = known[at : at + batch]
                for i, v in zip(places, encoder([values.iloc[i] for i in places]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return rows.withColumn(name, run(F.col(f"`{column}`")))


def encode_distinct(rows: DataFrame, column: str, encoder: Encoder = stand_in, batch: int = BATCH, name: str = "v") -> DataFrame:
    """rows with column name, each distinct text encoded once however many rows have it; null stays null.

    Texts are written to the shared folder with their vectors, so that no encoder is asked again when rows are read twice.
    """
    shared_dir(rows.sparkSession)
    text, vector = free_name(rows, "text"), free_name(rows, "vector")
    texts = rows.select(F.col(f"`{column}`").alias(text)).where(F.col(text).isNotNull()).distinct()
    vectors = encode(texts.repartition(text), text, encoder, batch, vector).checkpoint()
    return rows.join(vectors, F.col(f"`{column}`") == F.col(text), "left").withColumn(name, F.col(vector)).drop(*{text, vector} - {name})


def truncated(vector: Column, dims: int | None) -> Column:
    """The first dims numbers of a vector, brought to length one again; the whole vector where dims is None, zeros where nothing is left of it."""
    if dims is None:
        return vector
    if dims < 1:
        raise ValueError("a vector keeps one dimension at least")
    # a lambda's variable is worked out once, an expression within a lambda once for each number
    once = lambda value, then: F.transform(F.array(value), then)[0]
    scaled = lambda head, length: F.transform(head, lambda x: F.when(length > 0, x / length).otherwise(0.0))
    return once(F.slice(vector, 1, dims), lambda head: once(F.sqrt(dot(head, head)), lambda length: scaled(head, length)))


def encode_files(rows: DataFrame, path: str, files: str, encoder: Encoder = stand_in, batch: int = BATCH) -> DataFrame:
    """rows with column v: the vector of the file a path column names, loaded from folder files before it is encoded.

    A row whose file isn't there has a null vector. Files are told apart by the part of their path below the folder; only
    those that rows name are loaded, each once.
    """
    shared_dir(rows.sparkSession)
    below = F.substring_index(F.col("path"), f"{files.rstrip('/').split('/')[-1]}/", -1)
    wanted = rows.select(F.col(f"`{path}`").alias("_file")).where("_file is not null").distinct()
    loaded = rows.sparkSession.read.option("recursiveFileLookup", "true").format("binaryFile").load(files).select(below.alias("_file"), F.col("content").alias("_content"))
    vectors = encode(loaded.join(wanted, "_file", "left_semi"), "_content", encoder, batch).select("_file", "v").checkpoint()
    return rows.join(vectors, F.col(f"`{path}`") == F.col("_file"), "left").drop("_file")
