"""What a Python worker keeps from task to task: one object, so that stages do not pile up their caches, and no free memory."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa

_NAME = "slateql_worker_cache"


def per_process(key, make):
    """``make()``, made once a worker process until another key is asked for.

    Functions shipped by value start with fresh globals otherwise.
    """
    holder = sys.modules.setdefault(_NAME, types.ModuleType(_NAME))
    holder.asked = True
    if getattr(holder, "key", None) != key:
        holder.key = holder.made = None  # what was kept goes before the new one is made
        holder.made, holder.key = make(), key
    return holder.made


def _give_back() -> None:
    """Arrow and glibc keep what was freed for later, which adds up over the stages of a long session."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``emit`` for ``mapInArrow``; at a task's end free memory goes back to the system, and what ``per_process`` kept goes too unless the task asked for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder = sys.modules.setdefault(_NAME, types.ModuleType(_NAME))
        holder.asked = False
        try:
            yield from emit(batches)
        finally:
            if not holder.asked:
                holder.key = holder.made = None
            _give_back()

    return run
