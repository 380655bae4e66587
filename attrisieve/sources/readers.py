"""Readers of everything the plans start from."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.text import last_path_part, product_of_view
from ..session import shared_dir

#: Columns of judged tables and catalogues, in the names their sources give them (fixed values).
JUDGED = "row_id long, example_id long, query string, query_id long, product_id string, product_locale string, esci_label string, small_version long, large_version long, product_title string, product_text string"
CATALOGUE = ("image_id", "image_path", "item_id", "product_id", "split", "category1", "category2", "category3", "color", "description", "text")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path names, so it works in any store Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def judged(spark: SparkSession, path: str, schema: str = JUDGED) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, must_exist: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. A missing path gives no rows unless it must exist."""
    if not must_exist and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def catalogue(raw: DataFrame, limit: int | None = None, names: tuple[str, ...] = ("item_ID", "item_id")) -> DataFrame:
    """Catalogue records from raw rows: item_ID or item_id (or what else is among names) names the item; rows without one go; absent text is blank.

    limit keeps the first rows by row_id, before anything else goes.
    """
    own = raw.where(F.col("row_id") < limit) if limit else raw
    there = {c.lower(): c for c in own.columns}
    item = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in own.columns], F.lit(""))
    own = own.withColumn("_item", item).where("_item <> ''")
    text = lambda c: F.coalesce(F.col(there[c]).cast("string"), F.lit("")).alias(c) if c in there else F.lit("").alias(c)
    fixed = {"item_id": F.col("_item").alias("item_id"), "product_id": product_of_view(F.col("_item")).alias("product_id")}
    return own.select("row_id", *[fixed.get(c, None) if c in fixed else text(c) for c in CATALOGUE])


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines that aren't blank, of a file, a folder or a pattern; block is where the line's split of its file begins, at grows within it.

    Long files are read in splits by many tasks. at counts the lines of a task without gaps; as splits are dealt to tasks by
    sizes alone, it is the same whenever the same DataFrame is run.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return raw.where(F.col("value").rlike(r"\S")).withColumn("at", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value): lines that aren't blank with their place among all of them from 0, files by name.

    Lines are counted per split, and a split's lines are numbered from what stands before it, so lines are neither sorted nor
    shuffled, and a file of any length is read by many tasks.
    """
    lines = placed_lines(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    per_file = counts.groupBy("file").agg(F.sum("n").alias("m"))
    files = per_file.select("file", F.coalesce(F.sum("m").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per file
    inside = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.withColumn("inside", inside).join(files, "file").select("file", "block", (F.col("base") + F.col("inside") - F.col("first")).alias("offset"))
    return lines.join(begins, ["file", "block"]).select((F.col("at") + F.col("offset")).alias("row_id"), "value")


def whitespace_table(spark: SparkSession, path: str, least_columns: int) -> DataFrame:
    """(row_id, parts) of lines after the first two that aren't blank, split at white space, with so many parts at least.

    row_id is the line's place among those that aren't blank. path is a file, or a folder whose files follow each other by
    name. Raises where it is missing.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return numbered_lines(spark, path).where("row_id >= 2").select("row_id", parts.alias("parts")).where(F.size("parts") >= least_columns)


def annotated_images(spark: SparkSession, partition_path: str, boxes_path: str) -> tuple[DataFrame, DataFrame]:
    """(partition rows, box rows) of the annotation files; no boxes where their file is missing."""
    rows = whitespace_table(spark, partition_path, 3)
    partition = rows.select("row_id", F.col("parts")[0].alias("image_name"), F.col("parts")[1].alias("item_id"), F.col("parts")[2].alias("split"))
    schema = "row_id bigint, image_name string, clothes_type string, pose_type string, bbox array<int>"
    if not path_exists(spark, boxes_path):
        return partition, spark.createDataFrame([], schema)
    found = whitespace_table(spark, boxes_path, 7)
    box = F.transform(F.slice("parts", 4, 4), lambda x: x.cast("int"))
    return partition, found.select("row_id", F.col("parts")[0].alias("image_name"), F.col("parts")[1].alias("clothes_type"), F.col("parts")[2].alias("pose_type"), box.alias("bbox"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb): decoded images, three bytes a pixel, line by line; nulls where a file can't be decoded, no row for an empty one.

    Spark's own image source decodes them, to one, three (blue first) or four channels of 8 bits; grey ones are repeated and
    transparency is dropped.
    """
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    pixels = F.hex("data")
    turned = {1: ("(..)", "$1$1$1"), 3: ("(..)(..)(..)", "$3$2$1"), 4: ("(..)(..)(..)..", "$3$2$1")}
    rgb = F.lit(None).cast("string")
    for channels, (pattern, order) in turned.items():
        rgb = F.when(F.col("nChannels") == channels, F.regexp_replace(pixels, pattern, order)).otherwise(rgb)
    size = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return raw.select(F.col("origin").alias("path"), size("width"), size("height"), F.unhex(rgb).alias("rgb"))


def runs(table: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Run rows, of some groups where given; the filter reaches the scan."""
    return table.where(F.col("group").isin(*groups)) if groups else table


#: Bytes of a split of a log; bytes of files or lines that a task hands on at once, about.
SPLIT, HANDED = 1 << 24, 1 << 22


def _store(base: str):
    """(file system of a folder, the folder as it names it), through pyarrow, which writers.files() uses as well."""
    from pyarrow import fs

    local = re.match("file:/*", base)
    return (fs.LocalFileSystem(), f"/{base[local.end() :]}") if local else fs.FileSystem.from_uri(base)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to a few tasks for each core."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism)


def run_files(spark: SparkSession, base: str) -> DataFrame:
    """(path, folder, name, size): files in the run folders below base, named like base/run-20250101_120000-<id>/files/<name>; those that are hidden or empty are left out.

    A task lists the names of the run folders, many tasks what lies in them, and the list goes to the shared folder; Spark's
    own sources would have the driver hold every file.
    """
    schema = "path string, folder string, name string, size bigint"
    base = base.rstrip("/")
    if not path_exists(spark, base):
        return spark.createDataFrame([], schema)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            store, root = _store(base)
            names = pa.array([x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and x.base_name.startswith("run-")], pa.string())
            yield from pa.table([names], names=["top"]).to_batches(10_000)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = _store(base)
        for batch in batches:
            rows = []
            for top in batch.column("top").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{root}/{top}/files", allow_not_found=True))
                folder = f"{base}/{top}"
                rows += [(f"{folder}/files/{x.base_name}", folder, x.base_name, x.size) for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith((".", "_"))]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "folder", "name", "size"])

    kept = f"{shared_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    _spread(spark.range(1, numPartitions=1).mapInArrow(tops, "top string")).mapInArrow(inside, schema).write.parquet(kept)
    return spark.read.schema(schema).parquet(kept)


def whole_texts(files: DataFrame, base: str) -> DataFrame:
    """(path, value): files (path) below base, each as one text."""
    base = base.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(base)
        for batch in batches:
            rows, size = [], 0
            for path in batch.column("path").to_pylist():
                with store.open_input_file(root + path[len(base) :]) as file:
                    rows.append((path, file.read()))
                size += len(rows[-1][1])
                if size > HANDED:
                    yield _packed(rows, _WHOLE)
                    rows, size = [], 0
            if rows:
                yield _packed(rows, _WHOLE)

    return _spread(files.select("path")).mapInArrow(read, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


def run_logs(spark: SparkSession, base: str, name: str = "output.log") -> DataFrame:
    """split_lines() of the logs in the run folders below base."""
    return split_lines(run_files(spark, base).where(F.col("name") == name), base)


def split_lines(files: DataFrame, base: str) -> DataFrame:
    """(file, block, at, value) as placed_lines() gives them, of files (path, size) below base; long ones are read in splits by many tasks."""
    base, split = base.rstrip("/"), SPLIT

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(base)
        for batch in batches:
            rows, size = [], 0
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with store.open_input_file(root + path[len(base) :]) as file:
                    for at, line in enumerate(lines_from(file, block, block + split)):
                        rows.append((path, block, at, line))
                        size += len(line) + len(path)
                        if size > HANDED:
                            yield _packed(rows, _LINES)
                            rows, size = [], 0
            if rows:
                yield _packed(rows, _LINES)

    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("block")
    lines = _spread(files.where("size > 0").select("path", block)).mapInArrow(read, "file string, block bigint, at bigint, value binary")
    return lines.withColumn("value", F.col("value").cast("string")).where(F.col("value").rlike(r"\S"))


_WHOLE = {"path": pa.string(), "value": pa.binary()}
_LINES = {"file": pa.string(), "block": pa.int64(), "at": pa.int64(), "value": pa.binary()}


def _packed(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def lines_from(file, start: int, end: int) -> list[bytes]:
    """Lines that begin at a byte of a file from start to before end, without their ends, which are those of Spark's text source: LF, CR or both."""
    ends = rb"\r\n|[\r\n]"
    file.seek(max(0, start - 1))
    data = bytearray(file.read(end - max(0, start - 1)))
    if start:  # what stands before the first end is of a line that began earlier
        first = re.search(ends, data)
        data = data[first.end() :] if first else bytearray()
    while data and not data.endswith((b"\r", b"\n")):
        more = file.read(1 << 16)
        if not more:
            break
        last = re.search(rb"[\r\n]", more)
        data += more[: last.end()] if last else more
    return [bytes(x) for x in re.split(ends, data)]


def folder_of(path: Column) -> Column:
    """The run folder of a file in it."""
    return F.regexp_extract(path, "^(.*)/files/[^/]*$", 1)


def run_dirs(listing: DataFrame) -> DataFrame:
    """(run_id, path): per run id the last of its directories by name. listing has path, named like run-20250101_120000-<id>."""
    run = F.element_at(F.split(last_path_part(F.col("path")), "-"), -1)
    return listing.groupBy(run.alias("run_id")).agg(F.max("path").alias("path"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """summaries_in() of files; no rows where there are none."""
    return summaries_in(_whole(spark, path))


def summaries_in(texts: DataFrame) -> DataFrame:
    """(path, metrics): the numbers of JSON summary files (path, value); an empty map where a file can't be read as JSON."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    numbers = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: v.try_cast("double").isNotNull())
    return texts.select("path", F.coalesce(F.transform_values(numbers, lambda k, v: v.try_cast("double")), empty).alias("metrics"))


def yaml_args(spark: SparkSession, path: str) -> DataFrame:
    """yaml_args_in() of files; no rows where there are none."""
    return yaml_args_in(_whole(spark, path))


def yaml_args_in(texts: DataFrame) -> DataFrame:
    """(path, args): the first args list of YAML metadata files (path, value), at whatever depth, read as a block list, which is how they are written."""
    block = F.regexp_extract("value", r"(?m)^[ \t]*args:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|$))*)", 1)
    items = F.transform(F.filter(F.split(block, r"\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s*", ""), F.lit("'\"")))
    return texts.select("path", items.alias("args"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    except AnalysisException:
        return spark.createDataFrame([], "path string, value string")


def arg_value(args, flag: str):
    """What follows a flag in an argument list; null without it."""
    at = F.array_position(args, flag)
    return F.when(at > 0, F.try_element_at(args, (at + 1).cast("int")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of logs and profiler reports in column value."""
    return spark.read.text(path)


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """entries_in() of files; no rows where there are none."""
    try:
        return entries_in(placed_lines(spark, path))
    except AnalysisException:
        return spark.createDataFrame([], "path string, key string, value double, place struct<block: bigint, at: bigint, nth: int>")


def entries_in(lines: DataFrame) -> DataFrame:
    """(path, key, value, place) of the flat dict literals that logs, as placed_lines(), print with a recall or accuracy at 5, one row per key.

    place orders a file's entries as they stand in it, over whatever tasks have read its splits. Literals that can't be read
    are left out; a value that is no number is null.
    """
    literal = r"\{[^{}]*(?:recall|accuracy)@5[^{}]*\}"
    found = lines.where(F.col("value").rlike(literal)).select("file", "block", "at", F.posexplode(F.regexp_extract_all("value", F.lit(literal), F.lit(0))).alias("nth", "literal"))
    words = F.col("literal")
    for python, plain in (("None", "null"), ("True", "true"), ("False", "false")):
        words = F.regexp_replace(words, rf"(?<![\w'\"]){python}(?![\w'\"])", plain)
    read = F.from_json(words, "map<string,string>", {"allowSingleQuotes": "true"})
    each = found.select("file", F.struct("block", "at", "nth").alias("place"), F.explode(read).alias("key", "value"))
    return each.select(F.col("file").alias("path"), "key", F.col("value").try_cast("double").alias("value"), "place")


def config(yaml_text: str, overrides: dict, defaults: dict) -> dict:
    """Settings: overrides that aren't None win over flat 'key: value' lines, those over defaults."""
    found: dict = {}
    for line in yaml_text.splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        if colon and value.strip() and not key.startswith((" ", "\t", "-")):
            text = value.strip().strip("'\"")
            if text.lower() in ("null", "~"):
                found[key.strip()] = None
                continue
            try:
                found[key.strip()] = json.loads(text.lower() if text.lower() in ("true", "false") else text)
            except ValueError:
                try:
                    found[key.strip()] = float(text)
                except ValueError:
                    found[key.strip()] = text
    return defaults | found | {k: v for k, v in overrides.items() if v is not None}
