"""Small helpers for operators that read Arrow batches of texts."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, concatenated, and len + 1 offsets into them. A null counts as the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def raw_texts(column: pa.Array):
    """Each text of the column as UTF-8 bytes; a null counts as the empty text."""
    data, offsets = utf8(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, a function of an iterator of batches, with memory given back after each batch it yields and at its end."""

    def wrapped(batches):
        for out in run(batches):
            yield out
            trim()
        trim()

    return wrapped


def lean_group(run):
    """run, a function of one or two tables of a group; what a group took goes back to the system before the next one comes."""
    import inspect

    def held(*tables):
        try:
            return run(*tables)
        finally:
            trim()

    if len(inspect.signature(run).parameters) == 1:
        return lambda one: held(one)
    return lambda one, two: held(one, two)
