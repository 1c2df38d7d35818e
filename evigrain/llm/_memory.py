"""Memory of Python workers: they are reused by later stages, so what a task frees should go back."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

PAUSE = 0.5


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool, and the C library's heap where it can be trimmed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` with freed memory given back between its batches (not more often than every ``PAUSE`` seconds) and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for made in work(batches):
                yield made
                if time.monotonic() - last > PAUSE:
                    del made
                    give_back()
                    last = time.monotonic()
        finally:
            give_back()

    return run
