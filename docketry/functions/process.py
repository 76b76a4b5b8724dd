"""Values kept once in a Python worker process, and memory it gives back."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable

import pyarrow as pa


def per_process(key: Hashable, make: Callable[[], object]) -> object:
    """A value made once in a Python process.

    Worker functions travel by value, so a module's own globals would be made anew
    for every task; this lives in the interpreter's module table instead.
    """
    kept = sys.modules.setdefault("_docketry_per_process", types.ModuleType("_docketry_per_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release() -> None:
    """Give memory that is no longer used back to the system: a worker goes on to other tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
