"""Rows of Arrow batches in Python, and batches of rows, both bounded in rows and bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

from glossaflow.functions.masking import PAIRS

BATCH_ROWS, BATCH_BYTES = 512, 2 << 20
SLICE = 32  # rows of a batch that are Python objects at a time
ARROW = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), PAIRS: pa.list_(pa.struct([("token", pa.string()), ("raw", pa.string())]))}


def _size(value) -> int:
    """About how large a value is, with all that it holds."""
    if isinstance(value, str | bytes):
        return len(value)
    if isinstance(value, dict):
        value = value.values()
    elif not isinstance(value, list):
        return 8
    return 64 + sum(map(_size, value))


def values_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, few of them as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def record_batches(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_ROWS`` rows or ``BATCH_BYTES``, all that rows hold counted."""
    fields = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(_size, row))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
