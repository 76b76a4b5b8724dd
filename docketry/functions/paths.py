"""Column functions on object paths and URIs."""

from pyspark.sql import Column, functions as F

# The storage layout that readers and writers agree on.
INPUT_PREFIX = "raw/cases_pdf/"
OUTPUT_PREFIX = "raw/cases_md/"
MARKDOWN_SUFFIX = ".md"

_URI = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)/?([\s\S]*)$"


def uri_bucket(uri: Column) -> Column:
    """`gs://b/x/y` -> `b`."""
    return F.regexp_extract(uri, _URI, 1)


def uri_path(uri: Column) -> Column:
    """`gs://b/x/y` -> `x/y`; empty when the URI stops at the bucket."""
    return F.regexp_extract(uri, _URI, 2)


def last_segment(path: Column) -> Column:
    """Name after the last `/`, trailing slashes ignored."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def stem(path: Column) -> Column:
    """Last segment without its last extension; a leading dot is no extension."""
    return F.regexp_replace(last_segment(path), r"(?<=.)\.[^.]+$", "")


def under_prefix(path: Column, prefix: str = INPUT_PREFIX) -> Column:
    return path.startswith(prefix)


def markdown_path(stem_col: Column, doc_id: Column, part: Column | None = None) -> Column:
    """Where a document's markdown belongs: `raw/cases_md/{stem}/{doc_id}.md`.

    Every part of a document has a path of its own: part 0 the one above, part `n` the same with `.part{n}`
    before the suffix.
    """
    number = F.lit("") if part is None else F.when(part == 0, "").otherwise(F.concat(F.lit(".part"), part.cast("string")))
    return F.concat(F.lit(OUTPUT_PREFIX), stem_col, F.lit("/"), doc_id, number, F.lit(MARKDOWN_SUFFIX))
