"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its tasks, and what it keeps is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy_batches(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving back memory at its end."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner
