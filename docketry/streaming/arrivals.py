"""New file -> page index -> one message per document, as a stream.

Arrival events come as small files with one envelope per row. Each micro-batch
reads the pages of the files it names, and only those.

A batch writes to a folder named after the query and the batch, in overwrite mode,
so a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry import schemas
from docketry.functions.paths import INPUT_PREFIX, under_prefix
from docketry.operators.messages import MAX_DELIVERY_ATTEMPTS, dead_letter_split, document_messages
from docketry.operators.paging import page_index, page_stamps
from docketry.session import materialise
from docketry.sinks.files import PAGE_SCHEMA, read_files, read_store, write_messages
from docketry.sources.envelopes import decode_envelopes, split_decoded


@dataclass(frozen=True)
class Layout:
    """Folders of one stream installation."""

    root: str
    generation: str = "1"

    @property
    def arrivals(self) -> str:
        return f"{self.root}/arrivals"

    @property
    def pages(self) -> str:
        return f"{self.root}/pages"

    @property
    def messages(self) -> str:
        return f"{self.root}/messages"

    @property
    def markdown(self) -> str:
        return f"{self.root}/markdown"

    @property
    def failures(self) -> str:
        return f"{self.root}/failures"

    @property
    def redelivered(self) -> str:
        return f"{self.root}/redelivered"

    def checkpoint(self, name: str) -> str:
        """A new `generation` starts the streams afresh on the same data."""
        return f"{self.root}/checkpoints-{self.generation}/{name}"


def run_id(batch: DataFrame) -> str:
    """Id of the query, the same over restarts on one checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def file_events(spark: SparkSession, path: str, glob: str = "*", max_files: int = 100) -> DataFrame:
    """The stream of envelopes below the directory `path`."""
    return (
        spark.readStream.schema(schemas.ENVELOPE)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def arrived_files(events: DataFrame, prefix: str = INPUT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """`(file_path, envelope)` of each arrived object below `prefix`, and undecodable rows.

    Objects elsewhere are well-formed and simply ignored.
    """
    good, bad = split_decoded(decode_envelopes(events, schemas.FILE_EVENT))
    files = good.filter(under_prefix(F.col("payload.name"), prefix)).select(
        F.concat(F.lit("gs://"), F.col("payload.bucket"), F.lit("/"), F.col("payload.name")).alias("file_path"),
        "envelope",
    )
    return files, bad


def without_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Events that name a file of which there are no pages."""
    return files.join(pages.select("file_path").distinct(), "file_path", "left_anti").select(
        "envelope", F.lit("no such object").alias("reason")
    )


def record_failures(failed: DataFrame, path: str) -> None:
    """One row per failed delivery; `count_attempts` and `dead_letter_split` read them."""
    failed.select(F.col("envelope").alias("message"), "reason").write.mode("overwrite").parquet(path)


FAILURES = "message string, reason string, run string, batch bigint, stage string"
REDELIVERED = "message string, stage string"


def read_failures(spark: SparkSession, layout: Layout) -> DataFrame:
    return read_store(spark, layout.failures, FAILURES)


def outstanding(spark: SparkSession, layout: Layout, max_attempts: int = MAX_DELIVERY_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Messages to deliver again and messages to give up, as `(stage, message, attempts)`.

    A message is open while it has failed more often than it was delivered again; one whose last delivery went
    well is neither.
    """
    by = ["stage", "message"]
    failed = read_failures(spark, layout).groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"))
    again = read_store(spark, layout.redelivered, REDELIVERED).groupBy(*by).agg(F.count(F.lit(1)).alias("again"))
    still = failed.join(again, by, "left").filter(F.col("attempts") > F.coalesce("again", F.lit(0))).drop("again")
    return dead_letter_split(still, max_attempts)


def redeliver(spark: SparkSession, layout: Layout, max_attempts: int = MAX_DELIVERY_ATTEMPTS) -> None:
    """Put open messages under the limit where their stream reads new ones.

    Delivery is at least once: what dies between the two writes is delivered again, which the streams bear.
    """
    retry, _ = outstanding(spark, layout, max_attempts)
    retry = materialise(retry.select("stage", "message"), "redelivery")
    if retry.isEmpty():
        return
    retry.filter("stage = 'index'").select(F.col("message").alias("envelope")).write.mode("append").parquet(layout.arrivals)
    retry.filter("stage = 'convert'").select(F.lit(None).cast("string").alias("key"), F.col("message").alias("value")).write.mode("append").parquet(
        f"{layout.messages}/redelivered"
    )
    retry.select("message", "stage").write.mode("append").parquet(layout.redelivered)


def start_index_stream(
    spark: SparkSession, layout: Layout, max_files: int = 100, prefix: str = INPUT_PREFIX
) -> StreamingQuery:
    """Turn arrival events into document messages; stops when all files are done."""

    def run(batch: DataFrame, batch_id: int) -> None:
        folder = f"run={run_id(batch)}/batch={batch_id}"
        files, bad = arrived_files(batch, prefix)
        pages = read_files(batch.sparkSession, layout.pages, PAGE_SCHEMA, files)
        record_failures(
            bad.select("envelope", "reason").unionByName(without_pages(files, pages)),
            f"{layout.failures}/{folder}/stage=index",
        )
        messages = document_messages(page_index(page_stamps(pages)))
        write_messages(messages, f"{layout.messages}/{folder}", "overwrite")

    return (
        file_events(spark, layout.arrivals, max_files=max_files)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", layout.checkpoint("index"))
        .trigger(availableNow=True)
        .start()
    )
