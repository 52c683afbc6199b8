"""Sources and sinks: frames, JSON documents, hashed files, row tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.sources.files import sha256

FRAMES = "scan_id string, page_index int, plane_index int, local_index int, channel int, height int, width int, pixels array<float>"
REVIEW_FLAG = "subject struct<animal_id:string,date:string,scan_id:string>, source_tiff string, status string, reason_code string, interpretation string, recorded_at_utc string, analysis_ids array<string>"


def frames(spark: SparkSession, path: str, channel: int | None = None) -> DataFrame:
    """Frames of a Parquet table; the channel filter is pushed to the scan."""
    d = spark.read.schema(FRAMES).parquet(path)
    return d if channel is None else d.where(F.col("channel") == channel)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON objects, one a file; a file that is no object is an error."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def listed_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path and size of files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", F.col("length").alias("size"))


def hashed_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, size, sha256 of files of any size: tasks read them piece by piece, a few files each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sha256(p) for p in b.column(0).to_pylist()], pa.string())], ["path", "size", "sha256"])

    return listed_files(spark, path, recursive).repartition("path").mapInArrow(run, "path string, size long, sha256 string")


def review_flags(spark: SparkSession, path: str) -> DataFrame:
    """Review flags of a glob of JSON files, with path and sha256 of each, in order of the path; a file that is no object is an error."""
    d = json_documents(spark, path, REVIEW_FLAG).select("*", F.col("_metadata.file_path").alias("path"))
    h = hashed_files(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("path_"), "sha256")
    return d.join(h, F.regexp_replace("path", "^file:/+", "/") == F.col("path_")).drop("path_").orderBy("path")


def discover(spark: SparkSession, root: str, animal: str, date: str, scan: str) -> str:
    """The one TIFF in the one session folder (operator_animal_date_scan_session) below ``root``; an error names how many folders or files there are."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(root).select("path")
    found = found.withColumn("folder", F.element_at(F.split("path", "/"), -2)).where(F.col("folder").rlike(f"^[^_]+_{re.escape(animal)}_{re.escape(date)}_{re.escape(scan)}_[^_]+$"))
    n = found.agg(F.count_distinct("folder").alias("folders"), F.count("*").alias("files"), F.min("path").alias("path")).first()
    if n["folders"] != 1 or n["files"] != 1:
        raise ValueError(f"{n['folders']} folders and {n['files']} stacks of {animal} {date} {scan} below {root}, not one of each")
    return n["path"]


def the_only_file(spark: SparkSession, path: str) -> str:
    """The path of the one file that a glob finds; an error for none or more."""
    found = [r["path"] for r in listed_files(spark, path).take(2)]
    if len(found) != 1:
        raise ValueError(f"{path} matches {'no file' if not found else 'more than one file'}")
    return found[0]


def write_rows(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes a row table; an empty one, or one that is there already, is an error."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")
    w = df.write.mode("errorifexists")
    (w.option("header", True).csv if kind == "csv" else w.parquet)(path)


def union_rows(*parts: DataFrame) -> DataFrame:
    """All columns of all parts, in the order first seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ragged(rows: DataFrame, plane: str, order: str, pixels: str, width: int, scan: Column | None = None) -> DataFrame:
    """Frames (scan_id, plane, local_index, width, pixels) of all rows of each plane of each stack, however many it has."""
    d = rows.select((F.lit("stack") if scan is None else scan).alias("scan_id"), F.col(plane).cast("long").alias("plane"), F.col(order).alias("order_"), F.lit(width).alias("width"), F.col(pixels).alias("pixels"))
    w = Window.partitionBy("scan_id", "plane").orderBy("order_")
    return d.select("scan_id", "plane", (F.row_number().over(w) - 1).cast("long").alias("local_index"), "width", "pixels")
