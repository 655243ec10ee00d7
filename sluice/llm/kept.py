"""What a Python worker keeps from one task to the next.

Spark gives a worker to one operator's tasks after another's, so without this what
an operator keeps would count in the memory of all later stages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa

_kept: dict[Hashable, object] = {}
_GC = gc.get_threshold()
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def keep(key: Hashable, make: Callable[[], object]) -> object:
    """What make() gave when this worker last met key; anything else that is kept goes."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """For tasks that keep nothing: lets all that is kept go, and gives back free memory."""
    if _kept:
        _kept.clear()
        gc.set_threshold(*_GC)
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
