"""Giving memory back between groups of rows.

Python workers are reused, and Spark keeps idle ones for a while. What glibc and
Arrow hold on to after a group's arrays are freed would stay with each of them, so
an executor's memory would be that of its workers' largest groups so far.
"""

from __future__ import annotations

import ctypes
from inspect import signature

import pyarrow as pa

# Other C libraries have no such function, and no need of it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def releasing(f):
    """A group function after whose calls freed memory is returned. It has as many
    arguments as ``f``, since Spark tells by them what a group function wants."""

    def run(*args):
        try:
            return f(*args)
        finally:
            release()

    shapes = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    return shapes[len(signature(f).parameters)]
