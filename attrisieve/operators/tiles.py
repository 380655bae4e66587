"""A grid of query tiles against base tiles, met in rounds.

Every query has to meet every row of a base. Both are dealt into tiles of a bounded size, by position, so that no value can
fill a tile; a task gets one query tile and one base tile, keeps what is best for each query, and the tasks' lists are merged
between rounds. Each round takes more base tiles than the one before and hands what the queries have found so far to the
next, so that later tasks return almost nothing. Nothing of either side reaches the driver but its count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows of a tile: at most, and at least before there are more tiles than tasks.
MOST, LEAST = 65_536, 1024
#: By what the number of base tiles grows from round to round.
GROWTH = 4


def deal(rows: DataFrame, name: str, most: int = MOST, least: int = LEAST, wanted: int | None = None) -> tuple[DataFrame, int]:
    """(rows as a checkpoint with column name, the tile from 0; how many tiles). wanted tiles (none: two a task) where their sizes allow it."""
    shared_dir(rows.sparkSession)
    kept = rows.checkpoint()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = kept.count()
    tiles = max(1, -(-n // min(most, max(least, -(-n // (wanted or 2 * tasks))))))
    return kept.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int")), tiles


def rounds(tiles: int, tasks: int) -> Iterator[tuple[int, int]]:
    """The base tiles [from, to) of each round; the first round has about one for each task."""
    at, size = 0, max(1, tasks)
    while at < tiles:
        yield at, min(tiles, at + size)
        at, size = at + size, size * GROWTH


def meet(queries: DataFrame, base: DataFrame, query_tiles: int, span: tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What run(queries of a tile, base rows of a tile) returns for every query tile and the base tiles of span.

    queries has query_tile and base base_tile. Either side of a pair may lack rows.
    """
    low, high = span
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # queries may come from the base itself
    left = queries.withColumn("base_tile", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    right = base.where(F.col("base_tile").between(low, high - 1)).withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    keys = ["query_tile", "base_tile"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def first_of(found: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, as a checkpoint; tasks drop the others before anything is shuffled."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place").checkpoint()
