"""Files as rows, read by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files below `path`: `(file_path, size, content)`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), "content")


def object_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths and sizes only; the contents are pruned and never read."""
    return read_objects(spark, path, glob).select("file_path", "size")
