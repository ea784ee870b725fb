"""What Python workers keep: they live on after a task, and share an executor's memory with whatever runs next."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_MEMORIES: dict[str, dict] = {}


def memory(name: str) -> dict:
    """What an operator remembers from task to task in this worker. The first task of anything else empties it."""
    return _MEMORIES.setdefault(name, {})


def forget(own: str = "") -> None:
    """Empties all memories but this one."""
    if others := [held for name, held in _MEMORIES.items() if held and name != own]:
        for held in others:
            held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Arrow and malloc keep what they had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str = "") -> Callable:
    """fn for ``mapInArrow``, so that it finds no memory but its own and gives back at the end what it had freed."""

    def run(batches):
        forget(own)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run
