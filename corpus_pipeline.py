"""A cleaning pipeline over documents: toxic rows go, one row of each near-duplicate group stays, rows that hold a
benchmark passage go, and what is left is packed into sequences.

Every stage works on all its predecessor kept. run() writes each stage's rows to the shared folder and reads them again; what
a stage has written goes once the next one has been.

All stages but the last return the columns of their input, of whatever names; nulls in other columns than the text stay as
they are. A null text counts as empty, a row with a null id as any other, and an empty table gives no rows. Texts of any
length are read whole, each by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attrisieve.llm import decontaminate, nearcopies, packing, simhash, toxicity
from attrisieve.llm.common import discard, fresh_path, table
from attrisieve.llm.registry import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the chain doesn't reject; it is fitted on the labelled ones of the input tables. Repeated rows fare alike."""
    chain = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, chain)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word similarities of 0.8 or more, found by SimHash and checked.

    The smallest id stays (a null one last), then the text with the smallest hash; of repeated rows one. All texts without
    words are one group.
    """
    return simhash.keep_first(docs, nearcopies.near_copies(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover no benchmark item to the threshold. Repeated rows fare alike."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence; repeated rows are pieces of their own."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: No stage has an SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
