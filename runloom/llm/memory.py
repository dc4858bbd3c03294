"""What operators keep in Python workers between tasks.

Workers are used again by later stages and jobs. What one operator has built there (tables,
memories of words) is let go when another one begins, so that an executor holds one of them
per worker and not all that a pipeline has built.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def claim(owner: str, free: Callable[[], None]) -> None:
    """Begin a task of ``owner``: free what others keep. ``free`` drops what it keeps itself."""
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    _kept[owner] = free
    if others:
        trim()


def trim() -> None:
    """Give unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not every C library has it; its memory is used again later
