"""Fixed-width vector columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.functions.vectors import has_width


def split_by_width(df: DataFrame, column: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has exactly `width` numbers, and the others."""
    good = has_width(F.col(column), width)
    return df.filter(good), df.filter(~good)


def require_width(df: DataFrame, **widths: int) -> DataFrame:
    """Fail the job on the first row whose vector is not of its declared width.

    The check is part of the column itself, so it runs wherever the column is read.
    """
    for column, width in widths.items():
        v = F.col(column)
        message = F.concat(F.lit(f"{column} must hold {width} numbers, found "), F.coalesce(F.size(v).cast("string"), F.lit("null")))
        df = df.withColumn(column, F.when(has_width(v, width), v).otherwise(F.raise_error(message).cast(df.schema[column].dataType)))
    return df
