"""Memory of Python workers.  A worker is used again by other operators; it keeps one operator's caches.

Caches are bounded by bytes and only save time.  When a worker turns to another operator, it empties
the caches of the one before and gives what is free back to the system.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: Most bytes of a cache.
MOST_BYTES = 64 << 20
#: What an entry takes besides its key's and value's own lengths: two objects and their place.
_ENTRY = 150

_caches: dict[str, list[dict]] = {}
_now = ""


def register(owner: str, cache: dict) -> dict:
    _caches.setdefault(owner, []).append(cache)
    return cache


def entries(value_bytes: int = 32, key_bytes: int = 10) -> int:
    """Most entries of a cache of such keys and values."""
    return MOST_BYTES // (_ENTRY + key_bytes + value_bytes)


def bound(cache: dict, most: int) -> None:
    if len(cache) > most:
        cache.clear()


def trim() -> None:
    """Gives free memory of Arrow and the C library back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def use(owner: str) -> None:
    """Empties the caches of all other owners."""
    global _now
    if owner != _now:
        _now = owner
        for other, held in _caches.items():
            if other != owner:
                for cache in held:
                    cache.clear()
        trim()
