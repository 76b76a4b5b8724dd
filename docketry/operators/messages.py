"""One message per document, and the rule for messages that keep failing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.functions.paths import uri_bucket, uri_path

# Fixed value: deliveries after which a message is given up.
MAX_DELIVERY_ATTEMPTS = 5


def document_messages(index: DataFrame) -> DataFrame:
    """`value` holds `{doc_id, min_page, max_page, bucket, file_path}` as JSON.

    `file_path` of the index is a URI; the message names bucket and path apart.
    """
    fields = F.struct(
        "doc_id",
        "min_page",
        "max_page",
        uri_bucket(F.col("file_path")).alias("bucket"),
        uri_path(F.col("file_path")).alias("file_path"),
    )
    return index.select(F.concat_ws("/", "file_path", "doc_id").alias("key"), F.to_json(fields).alias("value"))


def count_attempts(failures: DataFrame, message: str = "message") -> DataFrame:
    """One row per message with the number of its failed deliveries."""
    return failures.groupBy(message).agg(F.count(F.lit(1)).alias("attempts"))


def dead_letter_split(
    attempts: DataFrame, max_attempts: int = MAX_DELIVERY_ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """Messages still to be retried, and those that used up their attempts."""
    return attempts.filter(F.col("attempts") < max_attempts), attempts.filter(F.col("attempts") >= max_attempts)
