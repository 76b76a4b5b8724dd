"""Pages, messages and markdown documents as files below a path.

Pages and documents lie in `BUCKETS` folders by the first digits of a digest of the source file's full path, and are
sorted by it: a job that is told of some files opens their folders and reads their row groups. The number of folders
does not grow with the number of files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGE_SCHEMA = "file_path string, page bigint, page_text string, bucket string"
MARKDOWN_SCHEMA = (
    "file_path string, stem string, doc_id string, part bigint, n_parts bigint, n_pages bigint, object_path string, "
    "markdown string, bucket string, run string, batch bigint"
)

# Fixed value: folders of a store, named by two hexadecimal digits.
BUCKETS = 256


def bucket(file_path: Column | None = None) -> Column:
    path = F.col("file_path") if file_path is None else file_path
    return F.substring(F.md5(path.cast("binary")), 1, 2)


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Write `(file_path, page, page_text)`; ranges keep a long file in several tasks."""
    (
        pages.withColumn("bucket", bucket())
        .repartitionByRange("bucket", "file_path", "page")
        .sortWithinPartitions("bucket", "file_path", "page")
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def write_markdown(documents: DataFrame, path: str, run: str = "batch", batch: int = 0) -> None:
    """Write assembled documents of one batch of one run.

    Done again, the batch replaces its own folders and no others.
    """
    (
        documents.withColumns({"bucket": bucket(), "run": F.lit(run), "batch": F.lit(batch)})
        .repartitionByRange("bucket", "file_path", "doc_id", "part")
        .sortWithinPartitions("bucket", "file_path", "doc_id", "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "run", "batch")
        .parquet(path)
    )


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.write.mode(mode).parquet(path)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Everything below `path`; empty when there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_files(spark: SparkSession, path: str, schema: str, files: DataFrame) -> DataFrame:
    """The stored rows of the files named in the `file_path` column of `files`.

    At most `BUCKETS` names come to the driver, and only these folders are opened.
    """
    named = files.select("file_path", bucket().alias("bucket")).distinct()
    buckets = [row["bucket"] for row in named.select("bucket").distinct().collect()]
    stored = read_store(spark, path, schema).where(F.col("bucket").isin(buckets))
    return stored.join(named, ["file_path", "bucket"], "left_semi")
