"""Replaceable tables in a namespace, at stable paths that every session can read.

A table `namespace.table` lies at `{warehouse}/{namespace}/{table}`: version folders, and a manifest that names the published
one. The session catalog gets a view on it; a session whose catalog knows nothing reads the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.sinks.versions import free, new_version, outdated, publish

# Replaced versions are emptied after this time, so that readers that began before a replace can end.
RETENTION_S = 24 * 3600.0


def warehouse(spark: SparkSession) -> str:
    """The warehouse folder; on a cluster it must be named, as the default lies on the driver's own disk."""
    named = spark.conf.get("spark.sql.warehouse.dir", None)
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    given = spark.sparkContext.getConf().contains("spark.sql.warehouse.dir")
    if not named or not (local or given):
        raise ValueError("set spark.sql.warehouse.dir to a folder that all executors share")
    return named.rstrip("/")


def table_path(spark: SparkSession, namespace: str, table: str) -> str:
    return f"{warehouse(spark)}/{namespace}/{table}"


def ensure_namespace(spark: SparkSession, namespace: str) -> None:
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")


def show_version(spark: SparkSession, namespace: str, table: str, folder: str) -> None:
    """Point the catalog's `namespace.table` at a version; a plain table of that name gives way."""
    name = f"{namespace}.{table}"
    ensure_namespace(spark, namespace)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{folder}`")


def replace_table(df: DataFrame, namespace: str, table: str, retention_s: float = RETENTION_S) -> str:
    """Create or replace `namespace.table` with the rows and schema of `df`.

    Each write goes to a folder of its own, which is then published: readers see the old rows or
    the new ones, `df` may read the table it replaces, and a job that dies half-way leaves the old rows in
    place. Versions replaced longer ago than `retention_s` are emptied.
    """
    spark = df.sparkSession
    path = table_path(spark, namespace, table)
    folder = new_version(path)
    df.write.parquet(folder)
    publish(spark, path, folder)
    show_version(spark, namespace, table, folder)
    for old in outdated(spark, path, retention_s):
        free(spark, path, old)
    return f"{namespace}.{table}"
