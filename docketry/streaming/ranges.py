"""Page ranges of documents whose pages come bit by bit, as keyed streaming state.

`start_index_stream` indexes a file once, when it is announced. Here the page store itself is the stream: the first and last stamped page
of every document are state, new pages widen it, and each batch hands on the documents that it widened. A converter writes a document
again when its range grew, as a new version beside the old one; readers take the version of the widest range.

State is two numbers a document, kept in the checkpoint. A batch writes to folders named after the query and the batch, so one that runs
again replaces its own output. Ranges only widen, so all that was ever handed on, merged, is the current state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.paging import DOCUMENT_KEY, assemble_documents, page_range_slice, page_stamps
from docketry.sinks.files import BUCKETS, MARKDOWN_SCHEMA, PAGE_SCHEMA, bucket, read_files, read_store, write_markdown
from docketry.streaming.arrivals import Layout, run_id

RANGE = "file_path string, doc_id string, min_page bigint, max_page bigint"
STORED = f"{RANGE}, run string, batch bigint"


def ranges_path(layout: Layout) -> str:
    return f"{layout.root}/ranges"


def converted_path(layout: Layout) -> str:
    return f"{layout.root}/converted"


def versions_path(layout: Layout) -> str:
    return f"{layout.root}/versions"


def merged(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy(*DOCUMENT_KEY).agg(F.min("min_page").alias("min_page"), F.max("max_page").alias("max_page"))


def current_ranges(spark: SparkSession, layout: Layout) -> DataFrame:
    """The range of every document as of the last batch."""
    return merged(read_store(spark, ranges_path(layout), STORED))


def start_range_stream(spark: SparkSession, layout: Layout, max_files: int = 10 * BUCKETS, loose: bool = False) -> StreamingQuery:
    """Widen the ranges of documents by the pages that were stored since the last start; stops when all are read."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ranges_path(layout)}/run={run_id(batch)}/batch={batch_id}")

    pages = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(layout.pages)
    stamps = page_stamps(pages, loose)
    ranges = stamps.groupBy(*DOCUMENT_KEY).agg(F.min("page").cast("bigint").alias("min_page"), F.max("page").cast("bigint").alias("max_page"))
    return ranges.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", layout.checkpoint("ranges")).trigger(availableNow=True).start()


def wider(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Ranges of `wanted` that no range of `done` covers."""
    held = done.select(*[F.col(c).alias(f"{c}_done") for c in (*DOCUMENT_KEY, "min_page", "max_page")])
    same = [F.col(c) == F.col(f"{c}_done") for c in DOCUMENT_KEY]
    covers = (F.col("min_page_done") <= F.col("min_page")) & (F.col("max_page_done") >= F.col("max_page"))
    return wanted.join(held, [*same, covers], "left_anti")


def start_version_stream(spark: SparkSession, layout: Layout, max_files: int = 100) -> StreamingQuery:
    """Write a version of every document whose range grew; stops when all ranges are done."""

    def run(batch: DataFrame, batch_id: int) -> None:
        session, run_name = batch.sparkSession, run_id(batch)
        wanted = merged(batch.select(*DOCUMENT_KEY, "min_page", "max_page"))
        mine = (F.col("run") == run_name) & (F.col("batch") == batch_id)
        done = read_files(session, converted_path(layout), f"{STORED}, bucket string", wanted).filter(~mine)
        todo = wider(wanted, done)
        pages = read_files(session, layout.pages, PAGE_SCHEMA, wanted).drop("bucket")
        write_markdown(assemble_documents(page_range_slice(pages, todo)), versions_path(layout), run_name, batch_id)
        # Told last: a batch that dies before this writes its versions again.
        told = todo.withColumns({"bucket": bucket(), "run": F.lit(run_name), "batch": F.lit(batch_id)})
        told.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run", "batch").parquet(converted_path(layout))

    return (
        spark.readStream.schema(RANGE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .parquet(ranges_path(layout))
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", layout.checkpoint("versions"))
        .trigger(availableNow=True)
        .start()
    )


def read_versions(spark: SparkSession, layout: Layout) -> DataFrame:
    """Every document in the version of its widest range."""
    done = read_store(spark, converted_path(layout), f"{STORED}, bucket string")
    latest = Window.partitionBy(*DOCUMENT_KEY).orderBy(F.desc(F.col("max_page") - F.col("min_page")), F.desc("batch"), "run")
    chosen = done.withColumn("place", F.row_number().over(latest)).where("place = 1").select(*DOCUMENT_KEY, "bucket", "run", "batch")
    return read_store(spark, versions_path(layout), MARKDOWN_SCHEMA).join(chosen, [*DOCUMENT_KEY, "bucket", "run", "batch"], "left_semi")
