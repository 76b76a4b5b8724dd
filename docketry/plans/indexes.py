"""Vector and full-text indexes of a stored table."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docketry.operators import fulltext, ivf

log = logging.getLogger(__name__)


@dataclass
class TableIndexes:
    """The indexes a table has; None for one that could not be built."""

    vectors: dict[str, ivf.IvfIndex | None] = field(default_factory=dict)
    text: fulltext.TextIndex | None = None


def build_indexes(
    table: DataFrame, id_col: str, path: str, vectors: Mapping[str, int], text: str | None = None, **options
) -> TableIndexes:
    """Index vector columns of the given widths and a text column below `path`.

    An index is an extra: when one fails, the reason is logged and searches scan the table instead.
    """
    built = TableIndexes()
    for column, width in vectors.items():
        try:
            built.vectors[column] = ivf.build_index(table, id_col, column, width, f"{path}/{column}", **options)
        except Exception:
            log.warning("no vector index for %s", column, exc_info=True)
            built.vectors[column] = None
    if text is not None:
        try:
            built.text = fulltext.build_index(table, id_col, text, f"{path}/{text}")
        except Exception:
            log.warning("no text index for %s", text, exc_info=True)
    return built
