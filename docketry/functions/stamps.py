"""The stamp that ties a page to its document: `Num. 12 - Pág. 3`."""

from pyspark.sql import Column, functions as F

# The stamp format. Numbers never start with 0. The loose form
# takes any character where the strict one wants a dot.
STRICT_STAMP = r"Num\. ([1-9][0-9]*) - Pág\. ([1-9][0-9]*)"
LOOSE_STAMP = r"Num. ([1-9][0-9]*) - Pág. ([1-9][0-9]*)"


def stamp_pattern(loose: bool = False) -> str:
    return LOOSE_STAMP if loose else STRICT_STAMP


def stamped_document(text: Column, loose: bool = False) -> Column:
    """Document number of the first stamp on the page, `''` without one."""
    return F.regexp_extract(text, stamp_pattern(loose), 1)


def stamped_piece_page(text: Column, loose: bool = False) -> Column:
    """Page number inside the document, as printed in the first stamp."""
    return F.regexp_extract(text, stamp_pattern(loose), 2)
