"""Name a value once inside a column expression."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    Used where `body` refers to the value inside a lambda: written out, it would be
    computed again for every element.
    """
    return F.transform(F.array(value), body)[0]
