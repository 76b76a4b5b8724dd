"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension (text size, language, source, id) is quantised into cells of equal depth, with borders measured over
all rows, strings by the rank of the whole string. A row's cells give its index on a Hilbert curve, so rows that lie together on the curve are alike in
all dimensions. Rows are sorted by that index and cut into runs whose row counts differ by at most one (the law
`rows`); files written in this order have narrow minima and maxima in every dimension, and readers skip files by any of
them.

The order is made by ranges of index and id, so equal texts, one source or one cell spread over many tasks; positions come
from one total per range.

Edge cases: null text has size 1 and the checksum of the empty text; a null in a dimension sorts first; repeated rows
get slots one after another; fewer rows than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from docketry.session import materialise

SHARDS = 16
BITS = 5
LAW = "rows"
ACCURACY = 10_000


def string_borders(rows: DataFrame, dimension: str, cells: int) -> list[bytes]:
    """Strings that cut the rows into cells of about equal depth, from counts of the distinct values, whole strings compared.

    Values are summed up by range; the borders alone, fewer than `cells`, come to the driver.
    """
    value = F.col(dimension)
    counts = rows.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange("value").withColumn("__part", F.spark_partition_id())
    placed = materialise(placed, "values")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of the sort.
    bases = placed.groupBy("__part").agg(F.sum("n").alias("n"))
    bases = bases.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("__part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(bases), "__part")
    upto = F.col("upto") + F.col("base")
    # The value in which a share of the rows ends is a border.
    share = lambda c: F.floor(c * cells / F.col("total"))
    found = summed.where((share(upto) > share(upto - F.col("n"))) & (upto < F.col("total"))).select("value").collect()
    return sorted(r.value.encode() for r in found)


def string_cells(column: pa.Array, borders: list[bytes]) -> np.ndarray:
    """The number of borders below each string; nulls come first."""
    coded = column.dictionary_encode()
    of_value = np.array([bisect_left(borders, v.encode()) for v in coded.dictionary.to_pylist()] + [0], np.int64)
    return of_value[coded.indices.fill_null(len(of_value) - 1).to_numpy()]


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points in a cube with `2**bits` cells a side; one row per point.

    Gray-code walk: from the highest bit down, each dimension's bit reflects or swaps the lower bits of the first.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_here = (x[i] & q) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def on_curve(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """`rows` with `curve`, the Hilbert index of the quantised `dimensions` (numbers and strings)."""
    strings = [d for d in dimensions if isinstance(rows.schema[d].dataType, T.StringType)]
    numbers = [d for d in dimensions if d not in strings]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    # One row of 2**bits - 1 borders for each dimension comes to the driver.
    measured = rows.agg(*[F.percentile_approx(d, shares, ACCURACY).alias(d) for d in numbers]).first()
    borders = {d: np.unique(np.array(measured[d] or [], float)) for d in numbers}
    borders.update({d: string_borders(rows, d, 1 << bits) for d in strings})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for d in dimensions:
                column = batch.column(batch.schema.get_field_index(d))
                if d in strings:
                    cells.append(string_cells(column, borders[d]))
                else:
                    cells.append(np.searchsorted(borders[d], column.cast(pa.float64()).fill_null(-np.inf).to_numpy(), "left"))
            # Few distinct values take cells over the whole side, so their first bits tell them apart.
            cells = np.stack([c * (1 << bits) // (len(borders[d]) + 1) for d, c in zip(dimensions, cells)], axis=1)
            yield batch.append_column("curve", pa.array(hilbert_index(cells, bits)))

    return rows.mapInArrow(index, T.StructType([*rows.schema.fields, T.StructField("curve", T.LongType())]))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` in the order of `keys`, with `position` (from 0, gapless) and `total`."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    # The number of a partition and of a row within it, as the function packs them.
    placed = placed.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__row")).drop("__at")
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # One row for each range of the sort.
    bases = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"), F.sum("n").over(everything).alias("total"))
    return placed.join(F.broadcast(bases), "__part").withColumn("position", F.col("__base") + F.col("__row")).drop("__part", "__row", "__base")


def cut(position: Column, total: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot: the first `total % shards` shards have one row more."""
    least, more = F.floor(total / shards), total % shards
    border = more * (least + 1)
    shard = F.when(position < border, F.floor(position / (least + 1))).otherwise(more + F.floor((position - border) / F.greatest(least, F.lit(1))))
    start = shard * least + F.least(shard, more)
    return shard.cast("int"), (position - start).cast("long")


def shard_documents(documents: DataFrame, shards: int = SHARDS, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Shard and slot of every document, with the columns in `keep` carried along."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("row")] if keep else []
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(d).cast("string").alias(d) if d in documents.columns else F.lit("").alias(d) for d in ("lang", "source")],
        *kept,
    )
    rows = on_curve(materialise(rows, "metadata"), ["size", "lang", "source", "doc_id"], bits)
    rows = ranked(rows, ["curve", "doc_id", "text_crc32", "size"])
    shard, slot = cut(F.col("position"), F.col("total"), shards)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if keep else []),
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """The documents themselves, a folder per shard, each sorted along the curve."""
    placed = shard_documents(documents, shards, bits, keep=documents.columns)
    ordered = placed.select("row.*", placed["shard"].alias("__shard"), placed["slot"].alias("__slot"))
    ordered = ordered.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    ordered.drop("__slot").write.partitionBy("__shard").parquet(path)


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
