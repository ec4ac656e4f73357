"""Many 64-bit keys in few rows.

Steps that match hashes across a corpus would shuffle one row per hash. Here a
task sorts the hashes of a chunk of texts, keeps each once, cuts them by hash
range and sends one row per range with the hashes as a binary column. A key that
occurs in a third of all texts is then one entry per chunk, so no range grows
with a hot key. The bytes are laid out plane by plane (all first bytes, all
second bytes, ...), which lets the shuffle's compression remove equal high bytes.
"""

from __future__ import annotations

import numpy as np

from corpusguard.llm.words import U64


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unpack(data: bytes, dtype=U64) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def range_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """For ascending keys, where each of ``n`` equal hash ranges begins, with the end last."""
    return np.searchsorted(ranges(keys, n), np.arange(n + 1))


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each key."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def first_of_runs(keys: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
