"""Operator 11: whitening of embeddings by MLlib's singular vectors of the centred rows.

Entries become whole numbers on a fixed grid, so that sums and deviations are exact. The fit list holds each distinct vector
once. With n of them and sums S per dimension, n*x - S is a whole number too; centred rows are n*x - S over n, the singular
values that computeSVD gives for them, squared and over n, are the variances along the singular vectors. The total variance
isn't taken from those but from the exact deviations. Only numbers per dimension reach the driver: sums, the Gramian matrix
that computeSVD adds up in a tree, and the singular vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_columns, tidy

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Components whose singular value is below this share of the largest one are rounding noise and left out.
LEAST = 1e-6


@dataclass
class Whitening:
    """n distinct vectors, sums of their entries less SHIFT, unit vectors as columns and the variances along them, by falling variance; total: of all dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    reach: int  # no n*x - S of the fit list is further from zero

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total


def on_grid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """(vec_id, x): vectors as whole numbers; rows with a null vector or a null, NaN or infinite entry are left out.

    With ``dims`` shorter vectors end in zeros.
    """
    source = own_columns(rows, vec_id=id_col, v=vector_col).where("v is not null").withColumn("v", F.col("v").cast("array<double>"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)
    if dims is not None:
        x = F.concat(x, F.array_repeat(F.lit(SHIFT).cast("bigint"), dims - F.size(x)))
    return source.where(~odd).select("vec_id", x.alias("x"))


def _matrix(vectors: DataFrame, n: int, dims: int) -> RowMatrix:
    """A distributed matrix of the one column of vectors, arrays of doubles."""
    column = vectors.columns[0]
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(column).alias(column)), column), n, dims)


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """(the whitening, the fit list as a checkpoint); None where no vector varies, so that there is nothing to divide by."""
    fit_list = checkpoint(on_grid(rows, id_col, vector_col).select("x").distinct())
    sizes = fit_list.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    n, dims = sizes["n"], sizes["most"] or 0
    if sizes["least"] != sizes["most"]:
        fit_list = checkpoint(on_grid(rows, id_col, vector_col, dims).select("x").distinct())
        n = fit_list.count()
    if not n or not dims:
        return None, fit_list
    entries = fit_list.select(F.posexplode("x").alias("d", "c")).withColumn("c", F.col("c") - SHIFT)
    summed = sorted(entries.groupBy("d").agg(F.sum("c").alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).collect())  # a row per dimension
    shifted = [r["s"] for r in summed]
    reach = max(max(n * r["high"] - r["s"], r["s"] - n * r["low"]) for r in summed)
    centred = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in shifted]), lambda c, s: ((c - SHIFT) * F.lit(n).cast("bigint") - s).cast("double") / float(n))
    found = _matrix(fit_list.select(centred.alias("v")), n, dims).computeSVD(dims, rCond=LEAST)  # all of them: solved directly, not by iteration
    sigma, vectors = found.s.toArray(), found.V.toArray()
    kept = np.flatnonzero(sigma > LEAST * sigma[0])[:components]
    if not len(kept):
        return None, fit_list
    model = Whitening(n, [s + n * SHIFT for s in shifted], vectors[:, kept], sigma[kept] ** 2 / n, 0.0, reach)
    total = transform(fit_list.select(F.lit(0).alias("vec_id"), "x"), model).agg(F.sum("deviation")).first()[0]
    model.total = int(total) / n**3
    return model, fit_list


def transform(grid: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) per row of grid (vec_id, x): the exact sum of (n*x - S)^2, and the centred vector along the components over their deviations."""
    kind = grid.schema["vec_id"].dataType.simpleString()
    scaled = model.components / np.sqrt(model.variances)
    n, sums, dims = model.n, model.sums, model.dims
    small = dims * model.reach**2 < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = np.array([s - n * SHIFT for s in sums], dtype=np.int64 if small else object)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            off = (x - SHIFT) * n - less if small else (x.astype(object) - SHIFT) * n - less
            apart = (off * off).sum(axis=1).tolist()
            white = (off.astype(np.float64) / n) @ scaled
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(a) for a in apart], pa.decimal128(38)), listed], names=["vec_id", "deviation", "whitened"])

    return grid.select("vec_id", "x").mapInArrow(tidy(run), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the whitened fit list's covariance less the identity; whitened rows are centred again first."""
    white = checkpoint(transform(fit_list.select(F.lit(0).alias("vec_id"), "x"), model).select("whitened"))
    k = model.components.shape[1]
    means = _matrix(white, model.n, k).computeColumnSummaryStatistics().mean()
    centred = F.zip_with("whitened", F.array(*[F.lit(float(m)) for m in means]), lambda w, m: w - m)
    covariance = _matrix(white.select(centred.alias("w")), model.n, k).computeGramianMatrix().toArray() / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component, numbered from 1 by falling variance.

    Rows with a null vector or a null, NaN or infinite entry are left out; null ids and repeated rows are rows like any other;
    vectors shorter than the longest end in zeros. Components are as many as the data has, so a table whose vectors don't
    differ, or an empty one, gives no rows; equal variances leave the choice of their components open. Other columns are
    ignored.
    """
    model, fit_list = fit(rows, id_col, vector_col, components)
    kind = rows.schema[id_col].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(fit_list, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    each = transform(on_grid(rows, id_col, vector_col, model.dims), model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
