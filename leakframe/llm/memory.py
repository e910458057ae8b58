"""What a Python worker remembers between tasks.

Spark uses a worker again for other stages, so the memory of one operator would stay beside that
of the next.  A worker holds one such memory at a time, and what it frees goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_HELD: dict[str, dict] = {}


def hold(owner: str, cache: dict) -> None:
    """Keep ``cache`` and empty those of other owners."""
    others = [held for other, held in _HELD.items() if other != owner and held]
    for held in others:
        held.clear()
    if _HELD.get(owner) is not cache or others:
        give_back()
    _HELD[owner] = cache


def give_back() -> None:
    """Return freed memory: Python's objects, Arrow's pool, then what the C library keeps."""
    gc.collect()
    trim()


def trim() -> None:
    """As ``give_back()`` without a search for Python's cycles: cheap enough for every part of a batch."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if release is not None:
        release(0)
