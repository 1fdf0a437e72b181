"""What a Python worker keeps for its next task: one large object at a time, whichever operator made it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_held: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """The object of this key; what was held under another is let go before it is made."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def let_go() -> None:
    """Free what is held, before a task that needs its room, and give freed memory back to the machine."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
