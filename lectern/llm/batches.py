"""Arrow batches cut by bytes, so a Python worker's memory doesn't follow the length of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def cut(batch: pa.RecordBatch, column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch in order, each of one row or of at most `budget` bytes of `column`."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > budget and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes joined, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]
