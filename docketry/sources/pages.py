"""Plain text to numbered pages; each row is cut on its own, nothing shuffles.

The outer explode gives the same rows, as no text is without a page; the plain one
would filter on the array first and so compute it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pages_by_break(files: DataFrame, key: str, text: str, page_break: str = "\f") -> DataFrame:
    """Pages between `page_break` strings, numbered from 1, a missing text as `''`."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), _literal(page_break))
    return files.select(key, F.posexplode_outer(parts).alias("pos", "page_text")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("page"), "page_text"
    )


def pages_by_lines(files: DataFrame, key: str, text: str, lines_per_page: int = 10) -> DataFrame:
    """Pages of `lines_per_page` lines each, the last one shorter."""
    n = lines_per_page
    lined = files.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / n).cast("int"))
    paged = F.transform(starts, lambda i: F.array_join(F.slice("lines", i * n + 1, n), "\n"))
    return lined.select(key, F.posexplode_outer(paged).alias("pos", "page_text")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("page"), "page_text"
    )


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"
