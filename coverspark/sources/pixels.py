"""Pixel tables, parameter files and reports: Parquet, text and CSV."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIX = ["tile", "row", "col"]
TYPES = {"byte": "tinyint", "int16": "smallint", "int32": "int", "float32": "float", "float64": "double"}


def shared_folder(spark: SparkSession) -> str:
    """A new name under the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine that names none gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder so that the plan before them is cut."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def read_pixels(spark: SparkSession, path: str, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Pixels with NoData as null."""
    df = spark.read.parquet(path)
    return df if nodata is None else df.withColumn(value, F.nullif(F.col(value), F.lit(nodata)))


def write_pixels(df: DataFrame, path: str, dtype: str = "int16", nodata: float = 0, value: str = "value") -> None:
    """Typed pixels with nulls as ``nodata``, a folder per tile, rows in order within files."""
    out = df.withColumn(value, F.coalesce(value, F.lit(nodata)).cast(TYPES[dtype]))
    out.repartition("tile").sortWithinPartitions("tile", "row", "col").write.partitionBy("tile").parquet(path)


def store_pixels(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """The pixels as a table in buckets by tile, row and col, a file each, sorted.

    Joins by those columns between tables of as many buckets (pairs of maps, masks, samples) need no exchange, however
    large they are.  Without a path the table lies in the warehouse.
    """
    writer = df.repartition(buckets, *PIX).write.bucketBy(buckets, *PIX).sortBy(*PIX)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_blocks(df: DataFrame, path: str, side: int = 1250) -> None:
    """A folder for each tile and square of ``side`` pixels (br, bc), a file each, rows in order."""
    at = {"br": F.floor(F.col("row") / side).cast("int"), "bc": F.floor(F.col("col") / side).cast("int")}
    folders = ["tile", *at]
    df.withColumns(at).repartition(*folders).sortWithinPartitions(*folders, "row", "col").write.partitionBy(*folders).parquet(path)


def read_box(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, side: int = 1250) -> DataFrame:
    """Pixels of rows r0 to r1 and columns c0 to c1 (half open) of what ``write_blocks`` wrote: only squares that they touch are read."""
    touched = F.col("br").between(r0 // side, (r1 - 1) // side) & F.col("bc").between(c0 // side, (c1 - 1) // side)
    inside = (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    return spark.read.parquet(path).filter(touched & inside).drop("br", "bc")


def read_feature(df: DataFrame, feature: str, dtype: str = "int16") -> DataFrame:
    """One named dataset, rounded half to even."""
    return df.select("tile", "row", "col", F.bround(feature).cast(TYPES[dtype]).alias("value"))


def list_files(spark: SparkSession, folder: str, ext: str) -> DataFrame:
    """path and length of the files with an extension; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder)
    return files.select("path", "length")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name,N=..,W=..,S=..,E=..``; bounds are truncated to whole numbers."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bound = lambda k: F.regexp_extract("value", rf"{k}\s*=\s*([-0-9.]+)", 1).cast("double").cast("bigint").alias(k.lower())
    return lines.select(F.trim(F.split("value", ",")[0]).alias("tile"), *[bound(k) for k in "NWSE"])


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``KEY=VALUE`` with whole numbers; blank lines are dropped."""
    lines = spark.read.text(path).filter(F.trim("value").contains("="))
    parts = F.split("value", "=", 2)
    return lines.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).cast("int").alias("value"))


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``key r g b a - label``."""
    shape = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*-?\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract("value", shape, i)
    names = ["key", "r", "g", "b", "a"]
    lines = spark.read.text(path).filter(F.col("value").rlike(shape))
    return lines.select(*[part(i + 1).cast("int").alias(n) for i, n in enumerate(names)], part(6).alias("label"))


def read_class_keys(spark: SparkSession, path: str, indices: tuple[int, int, int, int] = (0, 1, 2, 3)) -> DataFrame:
    """Class key, description, group and group description by column position."""
    df = spark.read.option("header", True).csv(path)
    names = [("lc_key", "int"), ("description", "string"), ("grp_key", "int"), ("grp_desc", "string")]
    return df.select(*[F.col(f"`{df.columns[i]}`").cast(t).alias(n) for i, (n, t) in zip(indices, names, strict=True)])


def group_names(keys: DataFrame) -> DataFrame:
    """Each group's description: that of its last class."""
    return keys.groupBy("grp_key").agg(F.max_by("grp_desc", "lc_key").alias("grp_desc"))


def feature_list(df: DataFrame) -> DataFrame:
    """The features of a long table."""
    return df.select("feature").distinct()


def feature_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every feature of two products and which of them has it."""
    x, y = feature_list(a).withColumn("in_a", F.lit(True)), feature_list(b).withColumn("in_b", F.lit(True))
    joined = x.join(y, "feature", "full")
    return joined.select("feature", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.option("header", True).csv(path)


def run_record(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    """A run's parameters as key and value."""
    return spark.createDataFrame([(str(k), str(v)) for k, v in values.items()], "key string, value string")


def append_record(spark: SparkSession, values: Mapping[str, object], path: str, run: str) -> None:
    """Add a run's parameters to the log of all runs; earlier runs stay as they are."""
    run_record(spark, values).withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """run, key and value of all runs."""
    return spark.read.parquet(path).select("run", "key", "value")


def parse_scene(df: DataFrame, path: str = "path") -> DataFrame:
    """date, year, doy and scene_tile from file names like ``LANDSAT08.A2013144.h019v025.hdf``."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    stamp = F.regexp_extract(name, r"\.A(\d{7})", 1)
    date: Column = F.to_date(F.nullif(stamp, F.lit("")), "yyyyDDD")
    return df.withColumns(
        {"date": date, "year": F.year(date), "doy": F.dayofyear(date), "scene_tile": F.regexp_extract(name, r"\.(h\d+v\d+)", 1)}
    )
