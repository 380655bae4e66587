"""Writers of data sets, reports and ledgers."""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import path_exists


def jsonl(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in UTF-8, nulls kept; one_file suits small results only."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def parquet(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def append_ledger(record: DataFrame, path: str, run: str | None = None) -> None:
    """Add a row to a CSV ledger; each part file has its own header, so readers see one table.

    With a run the record has a folder of its own, which Spark writes aside and then puts in place: appending the same run
    again, as a retried call does, replaces it, so that each run counts once.
    """
    if run is None:
        record.coalesce(1).write.mode("append").option("header", "true").csv(path)
        return
    keyed = record.coalesce(1).withColumn("run", F.lit(run))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").partitionBy("run").csv(path)


def overwrite_partition(rows: DataFrame, path: str, key: str) -> None:
    """Replace the results of the key values in rows and leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written only where it isn't there yet."""
    if not path_exists(spark, path):
        make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def metrics_json(rows: DataFrame) -> str:
    """A one-row metric table as JSON with sorted keys."""
    row = rows.first()
    return json.dumps({} if row is None else {k: v for k, v in row.asDict().items() if v is not None}, sort_keys=True)


def log_rows(metrics: DataFrame, split: str) -> DataFrame:
    """(split, metric, value) from a one-row metric table, with the cosine_ of old names left out."""
    columns = [c for c in metrics.columns]
    values = F.array(*[F.struct(F.lit(f"{split}/{c.replace('cosine_', '')}").alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return metrics.select(F.lit(split).alias("split"), F.inline(values)).where("value is not null")


def text_report(examples: DataFrame, n: int = 20) -> str:
    """Markdown of the first n examples by row_id."""
    parts = ["# Examples", ""]
    for k, row in enumerate(examples.orderBy("row_id").limit(n).collect(), 1):
        r = row.asDict(recursive=True)
        parts += [f"## {k}. {r.get('original_query') or ''}", "", f"- query: {r.get('nl_query') or ''}", f"- rephrased: {r.get('rephrased_query') or ''}", f"- distance: {r.get('query_distance')}", f"- source: {r.get('negative_example_source') or ''}"]
        parts += [f"- {name}: {', '.join(r[f'selected_{name}'] or [])}" for name in ("pos", "neg", "common", "neither") if f"selected_{name}" in r]
        parts += ["", f"**Positive**: {r.get('positive_text') or ''}", "", f"**Negative**: {r.get('hard_text') or ''}", ""]
    return "\n".join(parts)


def metadata_lines(record: dict) -> list[str]:
    """'- name: value' for the fields that aren't blank."""
    return [f"- {k}: {v}" for k, v in record.items() if v not in (None, "")]


def image_block(title: str, image_path: str, record: dict, report_path: str) -> str:
    """A titled image, its path taken from the report's folder, and its metadata."""
    relative = posixpath.relpath(image_path, posixpath.dirname(report_path) or ".") if image_path else ""
    return "\n".join([f"### {title}", "", f"![{title}]({relative})" if image_path else "(no image)", "", *metadata_lines(record), ""])


def image_report(examples: DataFrame, report_path: str, n: int = 20) -> str:
    """Markdown of the first n image triplets by row_id: structs positive, hard and easy with image_path and metadata."""
    parts = ["# Image triplets", ""]
    for row in examples.orderBy("row_id").limit(n).collect():
        r = row.asDict(recursive=True)
        parts += [f"## {r['row_id']}", ""]
        parts += [image_block(name, r[name].get("image_path") or "", {k: v for k, v in r[name].items() if k != "image_path"}, report_path) for name in ("positive", "hard", "easy")]
    return "\n".join(parts)


def files(rows: DataFrame, folder: str) -> DataFrame:
    """(name, path): writes rows (name, content) as files below a shared folder, once each; names may have folders of their own.

    A file that is there already stays. Every executor writes through pyarrow's file systems, which take the folder's scheme;
    a file is written under another name and then moved, so a task that is run again leaves no half of one.
    """
    import uuid

    import pandas as pd

    def write(frames):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for pdf in frames:
            paths = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                path = f"{root}/{name}"
                if store.get_file_info(path).type == fs.FileType.NotFound:
                    store.create_dir(posixpath.dirname(path), recursive=True)
                    draft = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(draft) as out:
                        out.write(content)
                    store.move(draft, path)
                paths.append(path)
            yield pd.DataFrame({"name": pdf["name"], "path": paths})

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(write, "name string, path string")


def png(width: int, height: int, pixels: bytes, channels: int) -> bytes:
    """A PNG file of 8-bit samples: 1 channel is grey, 3 are colours, 4 have transparency."""
    kind = {1: 0, 3: 2, 4: 6}[channels]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + pixels[k * width * channels : (k + 1) * width * channels] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def materialise_rgb(images: DataFrame, folder: str) -> DataFrame:
    """(name, path): writes decoded images (name, width, height, rgb) as PNG files under safe names, once; those without pixels are left out."""
    import pandas as pd

    from ..functions.text import safe_filename

    def packed(frames):
        for pdf in frames:
            yield pd.DataFrame({"name": pdf["name"], "content": [png(w, h, x, 3) for w, h, x in zip(pdf["width"], pdf["height"], pdf["rgb"], strict=True)]})

    own = images.where("rgb is not null").select(F.concat(F.regexp_replace(safe_filename(F.col("name")), r"\.[^.]*$", ""), F.lit(".png")).alias("name"), "width", "height", "rgb")
    return files(own.mapInPandas(packed, "name string, content binary"), folder)


def materialise(images: DataFrame, folder: str) -> DataFrame:
    """(name, path): writes each image's bytes under a safe name to a shared folder, once; images have name and content."""
    from ..functions.text import safe_filename

    return files(images.select(safe_filename(F.col("name")).alias("name"), "content"), folder)


def whitespace_table(rows: DataFrame, path: str, header: str, order: str = "row_id") -> None:
    """Lines of rows (order, value) as an annotation table: their number, a header, then the lines by order.

    Part files follow each other by name, so a table of any length is written by many tasks.
    """
    spark = rows.sparkSession
    lines = rows.select(F.col(order).cast("bigint").alias("place"), "value")
    top = lines.agg(F.count("*").cast("string").alias("value")).select(F.lit(-2).cast("bigint").alias("place"), "value")  # one row
    second = spark.createDataFrame([(-1, header)], "place bigint, value string")
    lines.unionByName(top).unionByName(second).orderBy("place").select("value").write.mode("overwrite").text(path)
