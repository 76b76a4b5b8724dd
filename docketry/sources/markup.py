"""HTML pages to typed text items in reading order.

The markup is often broken (unclosed paragraphs, tags inside scripts), so it is
not parsed: parts without text are cut out, the text is split at every block
tag, opening or closing, and the tag before a piece gives its label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketry.functions.paths import uri_bucket
from docketry.operators.numbering import number_rows, unplaced

# Parts that hold no text, block tags, and label of each kind.
HIDDEN = (
    r"(?is)<(?:!--.*?-->|!doctype[^>]*>|head\b.*?</head\s*>|script\b.*?</script\s*>|style\b.*?</style\s*>)"
)
BLOCK_TAG = (
    r"(?i)<(/?(?:h[1-6]|p|li|body|div|article|section|header|footer|main|nav|aside|ul|ol"
    r"|table|tr|td|th|blockquote|pre))\b[^>]*>"
)
INLINE_TAG = r"(?i)</?[a-z][^>]*>"
SPACES = r"[ \t\r\n]{2,}|[\t\r\n]"  # all runs but the single blank, which stays as it is
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
HEADER_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LIST_TAG = "li"


def text_blocks(html: Column) -> Column:
    """`array<struct<label, text>>` of the non-empty blocks of one page.

    The costly steps run over the page as a whole, before it is split.
    """
    page = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    # Bytes 1 and 2 mark the tags; any in the input are blanked first.
    for mark in ("\x01", "\x02"):
        page = F.replace(page, F.lit(mark), F.lit(" "))
    page = F.regexp_replace(page, BLOCK_TAG, "\x01$1\x02")
    page = F.regexp_replace(page, INLINE_TAG, " ")
    for entity, char in ENTITIES:
        page = F.replace(page, F.lit(entity), F.lit(char))
    page = F.regexp_replace(page, SPACES, " ")

    def block(piece: Column) -> Column:
        tag = F.lower(F.substring_index(piece, "\x02", 1))
        label = (
            F.when(tag.isin(*HEADER_TAGS), "section_header").when(tag == LIST_TAG, "list_item").otherwise("text")
        )
        return F.struct(label.alias("label"), F.trim(F.substring_index(piece, "\x02", -1)).alias("text"))

    pieces = F.split(F.concat(F.lit("\x02"), page), "\x01")
    return F.filter(F.transform(pieces, block), lambda b: b["text"] != "")


def unplaced_pages(pages: DataFrame) -> DataFrame:
    """Pages without a url or a number, whose items `html_text_items` cannot place."""
    return unplaced(pages, ["url"], "page_id")


def html_text_items(pages: DataFrame, block_pages: int = 4096) -> DataFrame:
    """Items of every host, numbered through its pages by `page_id`.

    A page has one main header, so the host stands for the document and its pages
    follow one another. The numbering never gathers a whole host; the result is laid
    out by `(doc_id, block)` for the section operators.
    """
    blocks = pages.select(
        uri_bucket(F.col("url")).alias("doc_id"), "page_id", text_blocks(F.col("html")).alias("blocks")
    )
    items = number_rows(explode_blocks(blocks, "doc_id", "page_id"), ["doc_id"], "page_id", ["pos"], block_pages)
    return items.select(
        "doc_id",
        "row_idx",
        F.concat(F.lit("#/texts/"), F.col("row_idx").cast("string")).alias("self_ref"),
        "label",
        "text",
        "block",
    )


def explode_blocks(pages: DataFrame, *columns: str) -> DataFrame:
    """One row per element of `blocks`, with its place `pos`, `label` and `text`."""
    # The outer form: the plain one filters on the array first and so computes it twice.
    return (
        pages.select(*columns, F.posexplode_outer("blocks").alias("pos", "item"))
        .filter(F.col("item").isNotNull())
        .select(*columns, "pos", "item.label", "item.text")
    )
