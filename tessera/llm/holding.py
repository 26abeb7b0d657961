"""What a Python worker keeps from task to task: the one thing that the operator it last worked for made there.

Workers outlive the steps of a pipeline. What each step had left in them (tables of resolved words, automata) would add up in an executor's memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """make(), or what it made in an earlier task of this worker if nothing else was made since."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Gives what the worker keeps back to the system, the memory too."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)
