"""Tables found by namespace and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.functions.paths import last_segment, uri_bucket, uri_path
from docketry.sinks.catalog import show_version, table_path
from docketry.sinks.versions import published


def find_table(spark: SparkSession, namespace: str, table: str) -> str:
    """Qualified name of an existing table, `ValueError` when there is none.

    A table that another session published is looked up by its path and shown in this session's catalog.
    """
    name = f"{namespace}.{table}"
    last = published(spark, table_path(spark, namespace, table))
    if last is not None:
        show_version(spark, namespace, table, last["folder"])
    elif not spark.catalog.databaseExists(namespace) or not spark.catalog.tableExists(name):
        raise ValueError(f"table not found: {name}")
    return name


def read_table(spark: SparkSession, namespace: str, table: str) -> DataFrame:
    return spark.table(find_table(spark, namespace, table))


def find_table_folder(listing: DataFrame, namespace: str, table: str) -> str:
    """First folder of a `(prefix)` listing whose name ends with `_{namespace}${table}`."""
    suffix = f"_{namespace}${table}"
    hit = listing.filter(last_segment(F.col("prefix")).endswith(suffix)).agg(F.min("prefix")).first()[0]
    if hit is None:
        raise ValueError(f"no folder for table {namespace}.{table}")
    return hit.rstrip("/")


def distinct_prefixes(uris: DataFrame, uri: str) -> DataFrame:
    """The top-level folders below each bucket: `(bucket, prefix)`, each once."""
    path = uri_path(F.col(uri))
    return (
        uris.filter(path.contains("/"))
        .select(
            uri_bucket(F.col(uri)).alias("bucket"),
            F.concat(F.substring_index(path, "/", 1), F.lit("/")).alias("prefix"),
        )
        .distinct()
    )
