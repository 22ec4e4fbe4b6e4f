"""Arrow columns as numpy arrays, and back."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa


def binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and each value's offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return values[at[0] : at[-1]], at - at[0]


def longs(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def give_back() -> None:
    """At the end of a task: memory that is free but held goes back to the system, as a Python worker lives on beside the next step's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
