"""Groups of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with the same ``key``, for rows that arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        starts = [0, *edges.tolist(), len(values)]
        for n, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            if held and (n > 0 or held[0].column(key)[0].as_py() != values[0]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
