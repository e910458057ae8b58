"""Token ids in files, by a static range asymmetric numeral system.

Documents are put in ascending order of their ids by a range partition and encoded partition by
partition.  A *segment* of about a million ids has one frequency table, shared by its blocks.  A
block of 2**17 ids is coded by ``LANES`` interleaved states into one stream of 32-bit words, on
its own, so blocks decode in parallel.  Every 2**16 ids a block notes its states and its place in
the stream: a reader may begin at any of these checkpoints.  Checksums of the words and of the ids
are kept for each block and verified by the reader.

A file is a Parquet file of segments, written by Spark, so that it may lie in any store and a lost
task is simply run again.  Columns: ``part`` and ``segment`` (the order), ``n_tokens``, ``doc_ids``,
``doc_lengths`` (whole documents only), ``table`` and ``blocks``.

Coding and decoding run over all blocks of a segment at once in numpy: one step handles a symbol
of every lane of every block.

Defined results: a null or empty text has the end id only.  Null ids come first.  Rows that repeat
an id are all stored, in any order among themselves.  An empty table gives files without segments,
which read as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakframe.llm.tokens import encoder

BITS = 20  # precision of the frequencies: more than any vocabulary's size
LOW = 1 << 31  # states stay in [2**31, 2**63)
LANES = 256
BLOCK = 1 << 17
CHECK_STEPS = (1 << 16) // LANES
SEGMENT = 1 << 20

SEGMENTS = (
    "part int, segment int, n_tokens bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "table binary, blocks array<binary>"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_lengths", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(pa.binary())),
])
_HEAD = struct.Struct("<QIIII")  # ids, words, checkpoints, checksum of the words, of the ids


# ------------------------------------------------------------------ frequency tables
def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their shares of 2**BITS, each at least one."""
    symbols, counts = np.unique(ids, return_counts=True)
    room = (1 << BITS) - len(symbols)
    if room < 0:
        raise ValueError(f"more than {1 << BITS} different ids in a segment")
    share = 1 + (counts.astype(np.float64) * room / counts.sum()).astype(np.int64)
    share[np.argmax(share)] += (1 << BITS) - share.sum()
    return symbols.astype(np.uint32), share.astype(np.uint32)


def pack_table(symbols: np.ndarray, share: np.ndarray) -> bytes:
    steps = np.diff(symbols, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(struct.pack("<I", len(symbols)) + steps.tobytes() + share.astype("<u4").tobytes(), 6)


def unpack_table(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(raw)
    n = struct.unpack_from("<I", data)[0]
    both = np.frombuffer(data, "<u4", 2 * n, 4)
    return np.cumsum(both[:n], dtype=np.uint32), both[n:]


# ------------------------------------------------------------------ blocks
def _encode(ids: np.ndarray, index: np.ndarray, share: np.ndarray, before: np.ndarray) -> list[bytes]:
    """``ids`` of equal blocks, one per row; ``index``: their places in the table."""
    blocks, n = ids.shape
    steps = -(-n // LANES)
    laid = np.zeros((blocks, steps * LANES), index.dtype)
    laid[:, :n] = index
    laid = laid.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    marks: dict[int, np.ndarray] = {}
    low32, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    wide, under = share.astype(np.uint64), before.astype(np.uint64)
    for t in range(steps - 1, -1, -1):
        k = laid[:, t]
        f = wide[k]
        over = state >= f << np.uint64(63 - BITS)
        words[:, t] = state & low32
        sent[:, t] = over
        state = np.where(over, state >> shift, state)
        q = state // f
        state = (q << np.uint64(BITS)) + (state - q * f) + under[k]
        if t % CHECK_STEPS == 0:
            marks[t] = state.copy()
    out = []
    for b in range(blocks):
        stream = words[b][sent[b]].astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(sent[b].sum(1))])
        head = _HEAD.pack(n, len(stream) // 4, len(marks), zlib.crc32(stream), zlib.crc32(ids[b].astype("<u4").tobytes()))
        notes = b"".join(struct.pack("<II", t, counts[t]) + marks[t][b].astype("<u8").tobytes() for t in sorted(marks))
        out.append(head + notes + stream)
    return out


def _parts(raw: bytes) -> tuple[int, int, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """Number of ids, checksum of the ids, checkpoints (step, word, states) and words of a block."""
    n, n_words, n_marks, crc_words, crc_ids = _HEAD.unpack_from(raw)
    at, marks = _HEAD.size, []
    for _ in range(n_marks):
        marks.append((*struct.unpack_from("<II", raw, at), np.frombuffer(raw, "<u8", LANES, at + 8)))
        at += 8 + 8 * LANES
    if len(raw) - at != 4 * n_words or zlib.crc32(raw[at:]) != crc_words:
        raise ValueError("damaged block: the checksum of its words differs")
    return n, crc_ids, marks, np.frombuffer(raw, "<u4", n_words, at)


class Decoder:
    def __init__(self, table: bytes):
        symbols, share = unpack_table(table)
        self.symbols = symbols
        self.wide = share.astype(np.uint64)
        self.under = np.cumsum(self.wide) - self.wide
        self.place = np.repeat(np.arange(len(symbols), dtype=np.uint32), share)

    def _run(self, state: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        """``steps`` symbols of each lane; a row of ``state`` is a stream that reads on at ``at``."""
        out = np.empty((len(state), steps, LANES), np.uint32)
        mask = np.uint64((1 << BITS) - 1)
        for t in range(steps):
            slot = state & mask
            k = self.place[slot]
            out[:, t] = self.symbols[k]
            state = self.wide[k] * (state >> np.uint64(BITS)) + slot - self.under[k]
            need = state < np.uint64(LOW)
            order = np.cumsum(need, axis=1)
            word = words[(at[:, None] + order - 1)[need]]
            state[need] = (state[need] << np.uint64(32)) | word
            at = at + order[:, -1]
        return out

    def blocks(self, raws: list[bytes]) -> np.ndarray:
        """All ids of the blocks.  Every checkpoint is a reader of its own, so that the readers of
        all blocks advance together; those with the same number of steps form one run."""
        runs: dict[int, list] = {}
        sizes, sums, streams, base = [], [], [], 0
        for b, raw in enumerate(raws):
            n, crc, marks, words = _parts(raw)
            steps = -(-n // LANES)
            edges = [m[0] for m in marks] + [steps]
            for (t, word, state), end in zip(marks, edges[1:]):
                runs.setdefault(end - t, []).append((b, t, base + word, state))
            sizes.append(n)
            sums.append(crc)
            streams.append(words)
            base += len(words)
        words = np.concatenate([*streams, np.zeros(1, np.uint32)])
        found = [np.empty(-(-n // LANES) * LANES, np.uint32) for n in sizes]
        for steps, readers in runs.items():
            got = self._run(np.stack([r[3] for r in readers]).astype(np.uint64), words, np.array([r[2] for r in readers]), steps)
            for (b, t, _, _), ids in zip(readers, got):
                found[b][t * LANES:(t + steps) * LANES] = ids.reshape(-1)
        for b, n in enumerate(sizes):
            found[b] = found[b][:n]
            if zlib.crc32(found[b].astype("<u4").tobytes()) != sums[b]:
                raise ValueError("damaged block: the checksum of its ids differs")
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def span(self, raw: bytes, begin: int, end: int) -> np.ndarray:
        """The ids ``begin`` to ``end`` of a block, from the last checkpoint before them."""
        n, _, marks, words = _parts(raw)
        end = min(end, n)
        t, word, state = max((m for m in marks if m[0] * LANES <= begin), key=lambda m: m[0])
        steps = -(-end // LANES) - t
        if steps <= 0:
            return np.zeros(0, np.uint32)
        words = np.append(words, np.uint32(0))
        ids = self._run(state[None].astype(np.uint64), words, np.array([word]), steps).reshape(-1)
        return ids[begin - t * LANES:end - t * LANES]


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """Table and blocks of the ids."""
    symbols, share = frequencies(ids)
    before = np.cumsum(share.astype(np.uint64)) - share
    index = np.searchsorted(symbols, ids).astype(np.uint32)
    whole = len(ids) // BLOCK * BLOCK
    blocks = _encode(ids[:whole].reshape(-1, BLOCK), index[:whole].reshape(-1, BLOCK), share, before) if whole else []
    if whole < len(ids):
        blocks += _encode(ids[None, whole:], index[None, whole:], share, before)
    return pack_table(symbols, share), blocks


# ------------------------------------------------------------------ files
def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, segment: int = SEGMENT) -> None:
    """Write the ids of all texts to ``folder``, in ascending order of the id."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs_, lengths, waiting, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            table, blocks = encode_segment(np.concatenate(waiting))
            row = [[part], [number], [held], [docs_], [lengths], [table], [blocks]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in batches:
            for first, stop, ids, counts in encoder(tokenizer).parts(batch.column(1)):
                counts = counts + 1
                ids = np.insert(ids.astype(np.uint32), np.cumsum(counts - 1), np.uint32(end_id))
                bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
                begin = 0
                for i, doc in enumerate(batch.column(0).slice(first, stop - first).to_pylist()):
                    docs_.append(doc)
                    lengths.append(bounds[i + 1] - bounds[i])
                    held += lengths[-1]
                    if held >= segment:
                        waiting.append(ids[bounds[begin]:bounds[i + 1]])
                        yield flush()
                        docs_, lengths, waiting, held, begin = [], [], [], 0, i + 1
                        number += 1
                if bounds[-1] > bounds[begin]:
                    waiting.append(ids[bounds[begin]:])
        if held:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every stored document, and on request
    ``ids``.  The blocks are decoded where they are read; only narrow rows are joined with the
    totals of the segments before them."""
    schema = "part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                ids = Decoder(row["table"].as_py()).blocks(row["blocks"].as_py())
                lengths = row["doc_lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = list(zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist()))
                n = len(lengths)
                columns = [
                    pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["segment"].as_py()] * n, pa.int32()),
                    row["doc_ids"].values, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64()),
                ]
                names = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    stored_rows = spark.read.schema(SEGMENTS).parquet(folder)
    decoded = stored_rows.select("part", "segment", "doc_ids", "doc_lengths", "table", "blocks").mapInArrow(documents, schema)
    # one row per range partition, then one per segment of a partition
    parts = stored_rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = stored_rows.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("segment_start"))
    starts = segments.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("before"))
    return decoded.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
