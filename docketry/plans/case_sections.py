"""Stamped pages to sectioned, embedded text: the whole case job as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.operators.embedding import TEXT_WIDTH, embed_hashed
from docketry.operators.numbering import number_rows
from docketry.operators.paging import DOCUMENT_KEY, first_documents, page_index, page_range_slice, page_stamps
from docketry.operators.sections import attach_sections
from docketry.operators.vectors import require_width
from docketry.plans.indexes import TableIndexes, build_indexes
from docketry.sinks.catalog import replace_table
from docketry.sources.markup import explode_blocks

NAMESPACE = "sandbox"
TABLE = "case_sections"

# Pages whose items are numbered in one window.
BLOCK_PAGES = 4096


def document_items(pages: DataFrame, ranges: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Items of each document in reading order, numbered from 0 through the pages of its range.

    `pages` has `(file_path, page, blocks)`, where `blocks` lists the typed texts of
    the page as `array<struct<label, text>>`.
    """
    sliced = page_range_slice(pages.select("file_path", "page", "blocks"), ranges)
    rows = explode_blocks(sliced, *DOCUMENT_KEY, "page")
    return number_rows(rows, DOCUMENT_KEY, "page", ["pos"], block_pages)


def case_sections(
    pages: DataFrame,
    n: int | None = None,
    keep_last_section: bool = False,
    block_pages: int = BLOCK_PAGES,
) -> DataFrame:
    """Sectioned items of all documents, or of the first `n` of each file.

    `pages` has `(file_path, page, page_text, blocks)`.
    """
    ranges = page_index(page_stamps(pages))
    if n is not None:
        ranges = first_documents(ranges, n)
    items = document_items(pages, ranges, block_pages)
    return attach_sections(items, DOCUMENT_KEY, keep_last_section, block="block")


def embed_sections(sections: DataFrame) -> DataFrame:
    embedded = sections.withColumn("text_embedding", embed_hashed(F.col("text"), TEXT_WIDTH))
    return require_width(embedded, text_embedding=TEXT_WIDTH)


def store_case_sections(pages: DataFrame, namespace: str = NAMESPACE, table: str = TABLE, **options) -> str:
    """Compute, embed and write; the write is the only pass over the encoder."""
    return replace_table(embed_sections(case_sections(pages, **options)), namespace, table)


def index_case_sections(stored: DataFrame, path: str, **options) -> TableIndexes:
    """Vector and full-text index of the stored table, by an id made of its key."""
    item_id = F.concat_ws("/", *DOCUMENT_KEY, F.col("index_x").cast("string"))
    return build_indexes(
        stored.withColumn("item_id", item_id), "item_id", path, {"text_embedding": TEXT_WIDTH}, "text", **options
    )
