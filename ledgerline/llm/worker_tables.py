"""Tables that a Python worker fills as it goes, such as hashes of words or ids of chunks: it holds one kind at a time.

A worker serves one pass after another, and would keep what all of them have left. So the first pass that needs another kind, or
none, empties the rest and gives the memory back. The tables only save work, so results don't hang on them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_CLEAR: dict[str, Callable[[], object]] = {}
_held: list[str | None] = [None]


def kind(name: str, clear: Callable[[], object]) -> None:
    """Names a kind of tables, and how they are emptied."""
    _CLEAR[name] = clear


def only(name: str | None) -> None:
    """Empties all tables but those of one kind, or all; costs nothing while the kind stays the same."""
    if _held[0] == name:
        return
    for other, clear in _CLEAR.items():
        if other != name:
            clear()
    _held[0] = name
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other systems may not
    if trim:
        trim(0)
