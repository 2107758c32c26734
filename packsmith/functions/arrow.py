"""Rows to Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: A batch is passed on when it holds so many rows, or so many bytes of binary values.
ROWS, BYTES = 4096, 8 << 20


def in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches; a large value leaves with its batch at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= ROWS or size >= BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def items_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in columns), strict=True):
            yield tuple(x.as_py() for x in row)
