"""Where some value may begin in texts: one pass over their bytes, whatever the number of values.

The first bytes of each value, its *anchor*, set bits of a map of at most 16 MiB, which all tasks
get.  Eight bytes at any place of a text are one number, so numpy looks up all places of a batch at
once.  No anchor is missed; a place that is none passes seldom, and whoever reads the places compares
the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR = 8  # bytes
MOST_BITS = 27  # 16 MiB
ROW_BITS = 15  # of bitmap_construct_agg
BITS_PER_ANCHOR = 32
SLICE = 1 << 20  # bytes that are looked up at once
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _place(words: np.ndarray, size: int, which: int, bits: int) -> np.ndarray:
    """Bit of each word of ``size`` bytes under one of the hash functions."""
    salted = words + np.uint64(size) * _FACTORS[2]
    return ((salted ^ (salted >> np.uint64(32))) * _FACTORS[which]) >> np.uint64(64 - bits)


def _cut(words: np.ndarray, size: int) -> np.ndarray:
    return words if size == ANCHOR else words & np.uint64((1 << (8 * size)) - 1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    """The map of ``anchor`` (binary, up to ``ANCHOR`` bytes), put together in tasks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            words = np.frombuffer(b"".join(a.ljust(ANCHOR, b"\0") for a in raw), "<u8")
            sizes = np.array([len(a) for a in raw])
            for size in np.unique(sizes).tolist():
                for which in range(len(_FACTORS)):
                    at = np.unique(_place(words[sizes == size], size, which, bits))
                    row, bit = (at >> np.uint64(ROW_BITS)).astype(np.int32), (at & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(bit)], names=["row", "bit"])

    rows = anchors.select("anchor").mapInArrow(places, "row int, bit bigint")
    out = np.zeros((1 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for row, made in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("made")).collect():
        out[row] = np.frombuffer(made, np.uint8)
    return out.reshape(-1)


def _found(data: np.ndarray, sizes: list[int], marks: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Size and places of what may be an anchor, slice by slice.  ``data`` ends in ``ANCHOR`` zeros."""
    last = len(data) - ANCHOR
    for begin in range(0, last, SLICE):
        for shift in range(min(ANCHOR, last - begin)):
            first = begin + shift
            words = np.frombuffer(data, "<u8", (min(SLICE, last - begin) - shift + ANCHOR - 1) // ANCHOR, first)
            for size in sizes:
                kept = _cut(words, size)
                at = np.flatnonzero(_set(marks, _place(kept, size, 0, bits)))
                for which in range(1, len(_FACTORS)):
                    at = at[_set(marks, _place(kept[at], size, which, bits))]
                if len(at):
                    yield size, first + ANCHOR * at


class Anchors:
    """The map of the distinct ``anchor`` of a table, for any number of searches."""

    def __init__(self, table: DataFrame):
        distinct = table.select("anchor").distinct()
        known = distinct.groupBy(F.octet_length("anchor").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.sizes = sorted(r["size"] for r in known)
        self.bits = min(MOST_BITS, max(ROW_BITS, (sum(r["n"] for r in known) * BITS_PER_ANCHOR).bit_length()))
        self.marks = table.sparkSession.sparkContext.broadcast(bitmap(distinct, self.bits))


def spots(texts: DataFrame, anchors: Anchors, reach: int) -> DataFrame:
    """``key``, ``anchor`` and ``tail`` (up to ``reach`` bytes from there) of each place of ``texts`` (``key``,
    ``body``) that may begin one of the ``anchors``, equal ones of a text once a batch."""
    sizes, bits, shared = anchors.sizes, anchors.bits, anchors.marks

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            keys, body = batch.column(0), batch.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(body.buffers()[1], "<i8", len(body) + 1, 8 * body.offset)
            raw = body.buffers()[2]
            if raw is None or bounds[-1] == bounds[0]:
                continue
            data = np.zeros(bounds[-1] - bounds[0] + ANCHOR, np.uint8)
            data[:-ANCHOR] = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]]
            ends, seen = bounds - bounds[0], set()
            for size, places in _found(data, sizes, marks, bits):
                rows = np.searchsorted(ends, places, "right") - 1
                stops = np.minimum(ends[rows + 1], places + reach)
                fits = places + size <= stops
                for row, at, stop in zip(rows[fits].tolist(), places[fits].tolist(), stops[fits].tolist()):
                    seen.add((row, size, data[at:stop].tobytes()))
            for part in _parts(seen):
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array([row for row, _, _ in part])).cast(pa.string()),
                    pa.array([tail[:size] for _, size, tail in part], pa.binary()),
                    pa.array([tail for _, _, tail in part], pa.binary()),
                ], names=["key", "anchor", "tail"])

    return texts.select("key", F.col("body").cast("binary").alias("body")).where("body IS NOT NULL").mapInArrow(
        search, "key string, anchor binary, tail binary"
    )


def _parts(found: set, size: int = 10_000) -> Iterator[list]:
    rows = list(found)
    for at in range(0, len(rows), size):
        yield rows[at:at + size]
