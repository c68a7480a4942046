"""Rows of Python helpers as Arrow batches of bounded size, many small files to a batch and large ones to several."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of a batch; the row that reaches a bound is its last.
ROWS, BYTES = 5_000, 4 << 20


def _size(value) -> int:
    return len(value) if isinstance(value, str | bytes) else sum(map(len, value)) if isinstance(value, list) else 8


def rows_of(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The rows of batches, one at a time."""
    for batch in batches:
        held = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in held)


def batched(rows: Iterable[tuple], schema: pa.Schema, most: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most`` rows, each sent once it holds ``size`` bytes."""
    held: list[tuple] = []
    used = 0
    for row in rows:
        held.append(row)
        used += sum(map(_size, row))
        if len(held) >= most or used >= size:
            yield _batch(held, schema)
            held, used = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
