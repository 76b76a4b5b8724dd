"""Document message -> markdown document, as a stream.

Messages are delivered at least once. Duplicates within a batch are dropped and
documents that an earlier batch or query wrote are skipped, so every document
is written once. A batch that is run again ignores its own earlier output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry import schemas
from docketry.operators.paging import DOCUMENT_KEY, assemble_documents, page_range_slice, unconverted
from docketry.sinks.files import MARKDOWN_SCHEMA, PAGE_SCHEMA, read_files, read_store, write_markdown
from docketry.streaming.arrivals import Layout, record_failures, run_id


def read_markdown(spark: SparkSession, layout: Layout) -> DataFrame:
    """All documents written so far."""
    return read_store(spark, layout.markdown, MARKDOWN_SCHEMA)


def decode_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(file_path, doc_id, min_page, max_page)` and rows that do not parse; page numbers may come as strings."""
    as_text = ", ".join(f"{name} string" for name in schemas.DOCUMENT_MESSAGE.fieldNames())
    parsed = messages.select(F.col("value").alias("envelope"), F.from_json("value", as_text).alias("m"))
    for field in schemas.DOCUMENT_MESSAGE:
        parsed = parsed.withColumn("m", F.col("m").withField(field.name, F.col("m")[field.name].try_cast(field.dataType)))
    complete = F.lit(True)
    for field in schemas.DOCUMENT_MESSAGE.fieldNames():
        complete = complete & F.col("m")[field].isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    good = parsed.filter(complete).select(
        F.concat(F.lit("gs://"), "m.bucket", F.lit("/"), "m.file_path").alias("file_path"),
        "m.doc_id",
        "m.min_page",
        "m.max_page",
    )
    return good, parsed.filter(~complete).select("envelope", F.lit("missing key or bad json").alias("reason"))


def already_written(spark: SparkSession, layout: Layout, wanted: DataFrame, run: str, batch_id: int) -> DataFrame:
    """Documents of the wanted files that other batches wrote."""
    mine = (F.col("run") == run) & (F.col("batch") == batch_id)
    written = read_files(spark, layout.markdown, MARKDOWN_SCHEMA, wanted)
    return written.filter(~mine).select(*DOCUMENT_KEY).distinct()


def start_convert_stream(spark: SparkSession, layout: Layout, max_files: int = 100) -> StreamingQuery:
    """Turn document messages into markdown; stops when all messages are done."""

    def run(batch: DataFrame, batch_id: int) -> None:
        session, run_name = batch.sparkSession, run_id(batch)
        good, bad = decode_messages(batch)
        record_failures(bad, f"{layout.failures}/run={run_name}/batch={batch_id}/stage=convert")
        wanted = good.dropDuplicates(list(DOCUMENT_KEY))
        todo = unconverted(wanted, already_written(session, layout, wanted, run_name, batch_id))
        pages = read_files(session, layout.pages, PAGE_SCHEMA, wanted).drop("bucket")
        write_markdown(assemble_documents(page_range_slice(pages, todo)), layout.markdown, run_name, batch_id)

    return (
        spark.readStream.schema("key string, value string")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .parquet(layout.messages)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", layout.checkpoint("convert"))
        .trigger(availableNow=True)
        .start()
    )
