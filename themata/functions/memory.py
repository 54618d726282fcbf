"""Memory of workers, which live on for other stages."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def release_memory() -> None:
    """Give memory that a task has freed back to the system, as its worker lives on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it has
