"""Analysing experiment runs: runs(run_id, name, group, created_at, config) and history(run_id, step..., metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import close_to, created_seconds, first_number_token, first_present, token_after
from ..sources import readers

#: Keys a run may hold recall at k under, in the order they are tried (fixed values).
RECALL_KEYS = (
    "val/recall@{k}", "test/recall@{k}", "val/val_recall@{k}", "test/test_recall@{k}", "val_cosine_recall@{k}", "test_cosine_recall@{k}", "cosine_recall@{k}", "val_recall@{k}", "test_recall@{k}", "recall@{k}",
    "val_cosine_accuracy@{k}", "test_cosine_accuracy@{k}", "cosine_accuracy@{k}", "val_accuracy@{k}", "test_accuracy@{k}", "accuracy@{k}",
)


def last_values(history: DataFrame, order: Column) -> DataFrame:
    """(run_id, metric, value): the last value of each metric that isn't null."""
    known = history.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy("run_id", "metric").agg(F.max_by("value", order).alias("value"))


def first_values(history: DataFrame, order: Column) -> DataFrame:
    """(run_id, metric, value): the first value, null or not."""
    return history.groupBy("run_id", "metric").agg(F.min_by("value", order).alias("value"))


def with_summary(last: DataFrame, summary: DataFrame) -> DataFrame:
    """The value a run's summary gives a metric comes before that of its history."""
    joined = summary.withColumnRenamed("value", "told").join(last, ["run_id", "metric"], "full")
    return joined.select("run_id", "metric", F.coalesce("told", "value").alias("value"))


def wide(values: DataFrame, metrics: list[str]) -> DataFrame:
    """A row per run, a column per metric; null where a run lacks it."""
    return values.groupBy("run_id").pivot("metric", metrics).agg(F.first("value"))


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def style_of(config_style: Column, name: Column) -> Column:
    """The configured training style, or the first token of the run's name; the older name of the margin style is mapped."""
    style = F.coalesce(F.nullif(config_style, F.lit("")), F.try_element_at(F.split(name, "_"), F.lit(1)))
    return F.when(style == "ours-mse", "marginal-mse").otherwise(style)


def sweep(runs: DataFrame, groups: list[str], mark: str) -> DataFrame:
    """Runs of the groups with the number that follows a mark in their name; those without one go."""
    value = token_after(F.col("name"), mark).try_cast("double")
    return runs.where(F.col("group").isin(*groups)).withColumn("x", value).where("x is not null")


def mean_per_x(rows: DataFrame, x: str, y: str, hue: list[str]) -> DataFrame:
    """What a line plot draws: the mean of y at each x and hue."""
    return rows.groupBy(*hue, x).agg(F.avg(y).alias(y))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def best_baselines(runs: DataFrame) -> DataFrame:
    """(dataset_size, run_id, name): of runs with 'baseline' in their name, per size that with the shortest name, then the newest."""
    named = runs.where(F.lower("name").contains("baseline")).withColumn("dataset_size", first_number_token(F.col("name"))).where("dataset_size is not null")
    order = F.struct(F.length("name"), -created_seconds(F.col("created_at")), "run_id")
    return named.groupBy("dataset_size").agg(F.min_by(F.struct("run_id", "name"), order).alias("b")).select("dataset_size", "b.run_id", "b.name")


def with_baseline(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """runs (with dataset_size) beside the baseline of their size; null where there is none."""
    return runs.join(baselines.select("dataset_size", F.col("run_id").alias("baseline_id")), "dataset_size", "left")


def grid_series(rows: DataFrame, x: str, row: str, metrics: list[str]) -> DataFrame:
    """(row value, metric, style, x, y) for a grid of plots: rows without either value go."""
    variants = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in metrics])
    long_ = rows.select(F.col(row).alias("row_value"), "style", F.col(x).alias("x"), F.inline(variants))
    return long_.dropna(subset=["row_value", "x", "y"])


def ordered_series(rows: DataFrame) -> DataFrame:
    """(row_value, metric, style, points) of grid_series() rows: the points (x, y) a line goes through, by x, y the mean where an x comes again.

    Points that share an x are one before a series is put together, so it is as long as it has different x.
    """
    points = mean_per_x(rows, "x", "y", ["row_value", "metric", "style"])
    return points.groupBy("row_value", "metric", "style").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


def run_list(spark: SparkSession, runs: list[tuple], id_type: str = "string") -> DataFrame:
    """An inline relation (trained_on, method, evaluated_on, run_id)."""
    return spark.createDataFrame(runs, f"trained_on string, method string, evaluated_on string, run_id {id_type}")


def listed(runs: DataFrame, values: DataFrame, metrics: list[str]) -> DataFrame:
    """Listed runs beside a column per metric, of values (run_id, metric, value); null where a run or a metric isn't there."""
    return runs.join(wide(values.join(F.broadcast(runs.select("run_id").distinct()), "run_id", "left_semi"), metrics), "run_id", "left")


def easy_and_hard(values: DataFrame) -> DataFrame:
    """(run_id, metric, variant, value): a metric whose name ends in _easy or _hard is that variant of it, others are 'all'."""
    variant = F.regexp_extract("metric", "_(easy|hard)$", 1)
    return values.select("run_id", F.regexp_replace("metric", "_(easy|hard)$", "").alias("metric"), F.when(variant == "", "all").otherwise(variant).alias("variant"), "value")


def mixed_order(column: str) -> list[Column]:
    """Order numbers by value, then texts, then nulls."""
    number = F.col(column).try_cast("double")
    return [F.col(column).isNull().asc(), number.isNull().asc(), number.asc(), F.col(column).asc()]


def recall_at(metrics: Column, k: int) -> Column:
    """Recall at k under the first of its usual keys that the map contains; accuracy stands in where no recall is there."""
    return first_present(metrics, [key.format(k=k) for key in RECALL_KEYS])


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps; the second wins where both have a key."""
    keep = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_concat(keep, second)


def merged_metrics(summaries: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, metrics): per run folder its summary's numbers with what its log told later over them.

    summaries (path, metrics) and entries (path, key, value, place) name run folders; of a key's entries the one that comes
    last wins, even where its value is null. Tasks keep one value a key before anything is shuffled.
    """
    first = summaries.select("path", F.explode("metrics").alias("key", "value")).select("path", "key", "value", F.lit(None).cast(entries.schema["place"].dataType).alias("place"))
    last = first.unionByName(entries).groupBy("path", "key").agg(F.max_by("value", F.struct(F.col("place").isNotNull().alias("logged"), "place")).alias("value"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metrics"))


def recall_table(listed: DataFrame, folders: DataFrame, summaries: DataFrame, entries: DataFrame, args: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 100)) -> DataFrame:
    """listed (trained_on, method, evaluated_on, run_id) with run_dir, recall_at_<k> per cut-off and the run's arguments as one text.

    folders (run_id, path), summaries (path, metrics), entries (path, key, value, place) and args (path, args) name run
    folders by path. A run without a folder has nulls, and no arguments.
    """
    # sorted, not broadcast: a list of paths is estimated by its file, which tells little of what the paths' files hold
    metrics, texts = merged_metrics(summaries, entries), args.select("path", F.array_join("args", " ").alias("verified_args"))
    told = folders.join(metrics.hint("merge"), "path", "left").join(texts.hint("merge"), "path", "left")
    recalls = [recall_at(F.col("metrics"), k).alias(f"recall_at_{k}") for k in cutoffs]
    found = told.select("run_id", F.col("path").alias("run_dir"), *recalls, "verified_args")
    return listed.join(found.hint("merge"), "run_id", "left").withColumn("verified_args", F.coalesce("verified_args", F.lit("")))


def read_recalls(spark: SparkSession, base: str, listed: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 100)) -> DataFrame:
    """recall_table() of the run folders below base, of which only those of listed runs, each run's newest, are read.

    A folder holds files/*summary.json, files/output.log and files/config.yaml, or some of them.
    """
    wanted = listed.select("run_id").distinct()
    files = readers.run_files(spark, base)
    folders = readers.run_dirs(files.select(F.col("folder").alias("path")).distinct()).join(wanted.hint("merge"), "run_id", "left_semi").checkpoint()
    own = files.join(folders.select(F.col("path").alias("folder")).hint("merge"), "folder", "left_semi")
    of_folder = lambda rows: rows.withColumn("path", readers.folder_of(F.col("path")))
    texts = lambda named: readers.whole_texts(own.where(named), base)
    summaries, args = readers.summaries_in(texts(F.col("name").endswith("summary.json"))), readers.yaml_args_in(texts(F.col("name") == "config.yaml"))
    entries = readers.entries_in(readers.split_lines(own.where("name = 'output.log'"), base))
    return recall_table(listed, folders, of_folder(summaries), of_folder(entries), of_folder(args), cutoffs)


def log_dicts(text: Column) -> Column:
    """Flat dict literals with an '@5' in a log, each as a map of text to number; the last one wins when they are merged."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*@5[^{}]*\}"), F.lit(0))
    return F.transform(found, lambda d: F.from_json(d, "map<string,double>", {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"}))


def easy_value_close(column: Column, value: float) -> Column:
    return close_to(column, value)
