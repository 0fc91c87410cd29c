"""What Python workers keep from task to task.

Models and tables are built once a worker and kept while its tasks are of one
operator. A worker that turns to another operator drops them first, and gives
the memory back to the system when a task ends."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

_owner: str | None = None
_clear: dict[str, list[Callable[[], None]]] = {}


def kept(owner: str):
    """Decorator: the cache of a function that only ``owner``'s tasks need."""

    def add(cached):
        _clear.setdefault(owner, []).append(cached.cache_clear)
        return cached

    return add


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def task(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, as a task of ``owner``."""

    def go(batches):
        from gridloom.llm import workers  # the worker's own module, not a pickled copy

        workers.enter(owner)
        try:
            yield from run(batches)
        finally:
            workers.leave()

    return go


def enter(owner: str) -> None:
    global _owner
    if owner != _owner:
        for name, clear in _clear.items():
            if name != owner:
                for f in clear:
                    f()
        gc.collect()
        _trim()
        _owner = owner


def leave() -> None:
    _trim()


def parts(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many rows and, but for a single row,
    bytes of text in a column."""
    at, held = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
    for i, n in enumerate(lengths):
        n = n or 0
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
