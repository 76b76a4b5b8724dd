"""Running positions inside a group that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def lay_out(rows: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Shuffle rows by `(*keys, block)`; rows with a null among these belong nowhere.

    Dropping them here and not at a later join lets all readers of the result have the
    same plan below the shuffle, so that it is run once.
    """
    placed = rows.withColumn("block", block)
    known = F.lit(True)
    for column in [*keys, "block"]:
        known &= F.col(column).isNotNull()
    return placed.filter(known).repartition(*keys, "block")


def unplaced(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows that `number_rows` leaves out, as they have no group or no place in it."""
    missing = F.lit(False)
    for column in [*keys, order]:
        missing |= F.col(column).isNull()
    return rows.filter(missing)


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    then: Sequence[Column | str] = (),
    block_size: int = 4096,
    name: str = "row_idx",
) -> DataFrame:
    """0-based position of each row of a group by `(order, *then)`, as column `name`.

    A group is cut into blocks, ranges of `block_size` values of the integer column
    `order`. Rows are numbered by a window inside `(*keys, block)` and shifted by the
    number of rows in earlier blocks; the window that adds these up sees one row per
    block. The result keeps the column `block` and stays laid out by `(*keys, block)`.

    Counting reads the same shuffled rows as numbering. It looks at every column, so
    that the two shuffles are alike and Spark runs one of them, and with it
    whatever comes before, once.
    """
    laid_out = lay_out(rows, keys, F.floor(F.col(order) / block_size))
    every_row = F.hash(*rows.columns) >= -(2**31)
    counts = laid_out.groupBy(*keys, "block").agg(F.count_if(every_row).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys, "block").orderBy(order, *then)
    return (
        laid_out.join(offsets, [*keys, "block"])
        .withColumn(name, F.col("before") + F.row_number().over(inside) - 1)
        .drop("before")
    )
