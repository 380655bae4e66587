"""Reading and ranking profiler reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEASURES = {"cumtime": "cumtime", "tottime": "tottime", "ncalls": "calls"}


def parse(lines: DataFrame, column: str = "value", only: tuple[str, ...] | None = None) -> DataFrame:
    """Profile lines as columns; other lines go, and so do other files than ``only`` names. calls is what stands before a '/'."""
    # six fields at white space; the last is file:line(function), taken apart from its end
    fields = F.split(F.trim(F.col(column)), r"\s+", 6)
    field = lambda i: F.coalesce(F.get(fields, F.lit(i)), F.lit(""))
    place = field(5)
    function = F.rtrim(F.substring_index(place, "(", -1), F.lit(")"))
    own = lines.select(field(0).alias("ncalls"), *[field(k).alias(n) for k, n in enumerate(("tottime", "percall", "cumtime", "percall2"), 1)], place.alias("place"), function.alias("funcname"))
    own = own.withColumn("before", F.left("place", F.length("place") - F.length("funcname") - 2))
    own = own.withColumn("lineno", F.substring_index("before", ":", -1))
    own = own.withColumn("filename", F.left("before", F.length("before") - F.length("lineno") - 1))
    counted = F.forall(F.split("ncalls", "/"), lambda x: x.rlike("^[0-9]+$")) & (F.size(F.split("ncalls", "/")) <= 2)
    measured = [F.col(n).rlike("^[0-9.]+$") & F.col(n).try_cast("double").isNotNull() for n in ("tottime", "percall", "cumtime", "percall2")]
    shaped = F.endswith("place", F.lit(")")) & F.contains("place", F.lit("(")) & (F.length("funcname") > 0) & (F.length("filename") > 0) & F.col("lineno").rlike("^[0-9]+$")
    for known in (counted, *measured):
        shaped = shaped & known
    own = own.where(shaped).select("ncalls", *[F.col(n).cast("double").alias(n) for n in ("tottime", "percall", "cumtime", "percall2")], "filename", F.col("lineno").cast("int").alias("lineno"), "funcname")
    own = own.withColumn("calls", F.split("ncalls", "/")[0].cast("bigint"))
    return own.where(F.col("filename").isin(*only)) if only else own


def by_cumulative_time(profile: DataFrame) -> DataFrame:
    return profile.orderBy(F.desc("cumtime"), "filename", "lineno", "funcname")


def top(profile: DataFrame, n: int = 10) -> DataFrame:
    """(measure, place, ...): the n largest by cumulative time, by own time and by calls. The limit is what is asked for."""
    key = lambda column: F.struct(-F.col(column).cast("double"), "filename", "lineno", "funcname")
    ranked = profile.select(*[F.struct(F.lit(measure).alias("measure"), key(column).alias("k")).alias(measure) for measure, column in MEASURES.items()])
    each = ranked.select(F.explode(F.array(*MEASURES)).alias("r")).select("r.measure", F.col("r.k.col1").alias("down"), "r.k.filename", "r.k.lineno", "r.k.funcname")
    place = F.row_number().over(W.partitionBy("measure").orderBy("down", "filename", "lineno", "funcname"))
    return each.withColumn("place", place).where(F.col("place") <= n).select("measure", "filename", "lineno", "funcname", (-F.col("down")).alias("amount"))


def significant(profile: DataFrame, least: float = 0.001) -> DataFrame:
    return profile.where((F.col("tottime") > least) | (F.col("cumtime") > least))
