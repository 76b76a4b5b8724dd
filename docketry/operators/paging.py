"""From stamped pages to document page ranges, slices and whole texts.

Pages are rows `(file_path, page, page_text, ...)`, with `page` counted from 1
and unique in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docketry.functions.paths import markdown_path, stem
from docketry.functions.stamps import stamp_pattern, stamped_document, stamped_piece_page

DOCUMENT_KEY = ("file_path", "doc_id")

# Bytes of text after which a document goes on in a further part.
PART_BYTES = 64 << 20


def page_stamps(pages: DataFrame, loose: bool = False) -> DataFrame:
    """The first stamp of each page; pages without one are dropped."""
    text = F.col("page_text")
    return pages.filter(text.rlike(stamp_pattern(loose))).select(
        "file_path",
        "page",
        stamped_document(text, loose).alias("doc_id"),
        stamped_piece_page(text, loose).alias("piece_page"),
    )


def page_index(stamps: DataFrame) -> DataFrame:
    """First and last stamped page of every document."""
    return stamps.groupBy(*DOCUMENT_KEY).agg(
        F.min("page").cast("bigint").alias("min_page"),
        F.max("page").cast("bigint").alias("max_page"),
    )


def first_documents(index: DataFrame, n: int = 4) -> DataFrame:
    """The `n` documents of each file that start earliest.

    The rank filter is applied before the shuffle as well, so every task hands
    on at most `n` rows per file.
    """
    order = Window.partitionBy("file_path").orderBy("min_page", "doc_id")
    return index.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def page_range_slice(pages: DataFrame, ranges: DataFrame, bin_pages: int = 64) -> DataFrame:
    """Every page inside a document's range, stamped for it or not.

    A range join: ranges are laid over bins of `bin_pages` pages and meet the
    pages on `(file_path, bin)`. A long file is many bins, so no file is one task.
    """
    binned = ranges.withColumn(
        "bin",
        F.explode(F.sequence(F.floor(F.col("min_page") / bin_pages), F.floor(F.col("max_page") / bin_pages))),
    )
    return (
        pages.withColumn("bin", F.floor(F.col("page") / bin_pages))
        .join(binned, ["file_path", "bin"])
        .filter(F.col("page").between(F.col("min_page"), F.col("max_page")))
        .drop("bin")
    )


def assemble_documents(slices: DataFrame, part_bytes: int = PART_BYTES, block_pages: int = 4096) -> DataFrame:
    """Text of each document from its pages, in page order.

    A document is written in parts, numbered from 0, each with a path of its own and `n_parts` beside it. A
    part ends after the page that takes it to `part_bytes`, so that a gathered group is bounded however long the
    document is. Parts in order, joined by the same blank line, give the text.
    """
    text = F.coalesce("page_text", F.lit("")).alias("text")
    block = F.floor((F.col("page") - F.col("min_page")) / block_pages).alias("block")
    pages = slices.select(*DOCUMENT_KEY, "page", text, block).withColumn("bytes", F.octet_length("text") + 2)
    # Bytes before a page: those of earlier blocks and, within the block, of earlier pages.
    earlier = Window.partitionBy(*DOCUMENT_KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*DOCUMENT_KEY, "block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pages.groupBy(*DOCUMENT_KEY, "block").agg(F.sum("bytes").alias("block_bytes"))
    blocks = blocks.select(*DOCUMENT_KEY, "block", F.coalesce(F.sum("block_bytes").over(earlier), F.lit(0)).alias("before"))
    at = F.col("before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    cut = pages.join(blocks, [*DOCUMENT_KEY, "block"]).withColumn("at", at).withColumn("piece", F.floor(F.col("at") / part_bytes))
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    gathered = cut.groupBy(*DOCUMENT_KEY, "piece").agg(
        F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("markdown")
    )
    # A page longer than a part leaves pieces empty, so parts are counted.
    of_document = Window.partitionBy(*DOCUMENT_KEY)
    numbers = cut.select(*DOCUMENT_KEY, "piece").distinct().select(
        *DOCUMENT_KEY, "piece",
        (F.row_number().over(of_document.orderBy("piece")) - 1).cast("bigint").alias("part"),
        F.count(F.lit(1)).over(of_document).alias("n_parts"),
    )
    return (
        gathered.join(numbers, [*DOCUMENT_KEY, "piece"])
        .withColumn("stem", stem(F.col("file_path")))
        .withColumn("object_path", markdown_path(F.col("stem"), F.col("doc_id"), F.col("part")))
        .select("file_path", "stem", "doc_id", "part", "n_parts", "n_pages", "object_path", "markdown")
    )


def unconverted(index: DataFrame, done: DataFrame) -> DataFrame:
    """Documents not yet in `done`, matched on the full path and number."""
    return index.join(done.select(*DOCUMENT_KEY), list(DOCUMENT_KEY), "left_anti")
