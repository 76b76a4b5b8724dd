"""Attach every text item to the section header before it.

Items are rows `(*keys, row_idx, label, text)` with `row_idx` unique in its
document. An item belongs to the nearest header before it, provided a later
header follows; headers themselves are not items. With `keep_last_section` the
items after the last header are kept too, with a null next header.

One document may hold a large share of all rows, so nothing here is
partitioned by document alone. Positions are cut into blocks of `block_rows`;
the work inside a block is a plain window, and what crosses block borders is
carried by a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.operators.numbering import lay_out

# Fixed value: the label of a header item.
HEADER_LABEL = "section_header"

BLOCK_ROWS = 65_536


def _block(block_rows: int) -> Column:
    return F.floor(F.col("row_idx") / block_rows)


def _is_header() -> Column:
    return F.coalesce(F.col("label") == HEADER_LABEL, F.lit(False))


def _header() -> Column:
    return F.when(_is_header(), F.struct("row_idx", F.coalesce("text", F.lit("")).alias("text")))


def _over(keys: Sequence[str], order: Column, last: int) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def section_headers(
    items: DataFrame, keys: Sequence[str] = ("doc_id",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Headers with the index of the next header, null on the last one."""
    headers = items.filter(F.col("label") == HEADER_LABEL).select(
        *keys, "row_idx", F.coalesce("text", F.lit("")).alias("text"), _block(block_rows).alias("block")
    )
    first_of_next = F.lead("first_idx").over(Window.partitionBy(*keys).orderBy("block"))
    after = (
        headers.groupBy(*keys, "block")
        .agg(F.min("row_idx").alias("first_idx"))
        .select(*keys, "block", first_of_next.alias("after"))
        .filter(F.col("after").isNotNull())
    )
    inside = Window.partitionBy(*keys, "block").orderBy("row_idx")
    return headers.join(after, [*keys, "block"], "left").select(
        *keys,
        F.col("row_idx").alias("index_y"),
        F.col("text").alias("text_y"),
        F.coalesce(F.lead("row_idx").over(inside), F.col("after")).alias("previous_section_index"),
    )


def _block_borders(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block: the last header of earlier blocks (`before`) and the index of the
    first header of later blocks (`after`); blocks with neither are left out."""
    per_block = items.groupBy(*keys, "block").agg(
        F.max(_header()).alias("last_header"), F.min(_header()["row_idx"]).alias("first_idx")
    )
    earlier, later = _over(keys, F.asc("block"), -1), _over(keys, F.desc("block"), -1)
    return per_block.select(
        *keys,
        "block",
        F.last("last_header", ignorenulls=True).over(earlier).alias("before"),
        F.last("first_idx", ignorenulls=True).over(later).alias("after"),
    ).filter(F.col("before").isNotNull() | F.col("after").isNotNull())


def attach_sections(
    items: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    keep_last_section: bool = False,
    block_rows: int = BLOCK_ROWS,
    block: str | None = None,
) -> DataFrame:
    """Section attach as windows inside blocks: the items are shuffled once.

    Items that `number_rows` has laid out by `(*keys, block)` are used as they lie;
    name their column in `block`. Block borders are computed from the same shuffled
    columns as the windows, so that Spark runs the shuffle and its input once.
    """
    columns = [*keys, "row_idx", "label", "text"]
    if block is not None:
        laid_out = items.select(*columns, F.col(block).alias("block"))
    else:
        laid_out = lay_out(items.select(*columns), keys, _block(block_rows))

    # Two functions of one window: the rows of a block are sorted once.
    inside = Window.partitionBy(*keys, "block").orderBy("row_idx")
    next_in_block = F.expr("lead(header_idx) IGNORE NULLS").over(inside)
    header_in_block = F.last(_header(), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    marked = (
        laid_out.join(_block_borders(laid_out, keys), [*keys, "block"], "left")
        .withColumn("header_idx", F.when(_is_header(), F.col("row_idx")))
        .withColumns({
            "header": F.coalesce(header_in_block, F.col("before")),
            "next_header": F.coalesce(next_in_block, F.col("after")),
        })
    )
    kept = ~_is_header() & F.col("header").isNotNull()
    if not keep_last_section:
        kept &= F.col("next_header").isNotNull()
    return marked.filter(kept).select(
        *keys,
        F.col("row_idx").alias("index_x"),
        "text",
        F.col("header.text").alias("section"),
        F.col("header.row_idx").alias("index_y"),
        F.col("next_header").alias("previous_section_index"),
    )


def attach_sections_join(
    items: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    bin_rows: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Section attach as a range join of items with header intervals.

    An interval is laid over bins of `bin_rows` positions, so an item meets only
    the headers whose interval touches its bin. Intervals of a document do not
    overlap, so there are no more interval rows than headers plus bins.
    """
    intervals = (
        section_headers(items, keys, block_rows)
        .filter(F.col("previous_section_index").isNotNull())
        .withColumn(
            "bin",
            F.explode(
                F.sequence(F.floor(F.col("index_y") / bin_rows), F.floor(F.col("previous_section_index") / bin_rows))
            ),
        )
    )
    placed = items.select(
        *keys,
        F.col("row_idx").alias("index_x"),
        F.col("text").alias("text_x"),
        F.floor(F.col("row_idx") / bin_rows).alias("bin"),
    )
    return (
        placed.join(intervals, [*keys, "bin"])
        .filter(
            (F.col("index_x") > F.col("index_y")) & (F.col("index_x") < F.col("previous_section_index"))
        )
        .select(
            *keys,
            "index_x",
            F.col("text_x").alias("text"),
            F.col("text_y").alias("section"),
            "index_y",
            "previous_section_index",
        )
    )
