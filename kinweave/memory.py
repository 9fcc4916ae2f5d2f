"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Free memory of this Python worker returns to the system: workers outlive their tasks, and all of an executor's count together."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
