"""What a Python worker keeps between tasks. Spark uses a worker again for other operators, so only one of them keeps its tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_owner: list = [None, None]


def claim(name: str, release: Callable[[], None]) -> None:
    """From now on `name` keeps tables here, and release() lets go of them; those of another owner go first."""
    if _owner[0] == name:
        return
    if _owner[1] is not None:
        gc.unfreeze()
        _owner[1]()
        gc.collect()
        let_go()
    _owner[:] = [name, release]


def let_go() -> None:
    """Give freed memory back to the system: an idle worker of an executor would keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: the memory stays with the process
        pass


def alone() -> None:
    """For operators that keep nothing."""
    claim("none", lambda: None)
