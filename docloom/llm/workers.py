"""What a Python worker keeps from task to task, for one operator at a time.

Spark hands a worker process from one stage to the next, so what an operator keeps there for its own
tasks would fill the executor while others run. A task says whose it is, and what others kept goes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: list = []
_operator: str | None = None


def kept(make: Callable) -> Callable:
    """The last value of ``make``, for all tasks of a worker until another operator's :func:`begin`."""
    cached = functools.lru_cache(maxsize=1)(make)
    _kept.append(cached)
    return cached


def begin(operator: str) -> None:
    """Called by each task before its work: the worker is ``operator``'s from now on."""
    global _operator
    if _operator not in (None, operator):
        for cached in _kept:
            cached.cache_clear()
        gc.collect()
    _operator = operator
    # what the task before has freed goes back to the system, too
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, else the allocator decides
    if trim:
        trim(0)
