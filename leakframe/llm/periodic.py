"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least three periods and ``SHORTEST`` words
long, that no word beside it extends with that period.

Scale by scale, k consecutive words are hashed at every place, and the smallest hashes of windows of
W places are selected.  The scale finds the periods q with low < q <= k, where W is 2 (low + 1) - k + 1:
a run of three periods then holds two whole windows q places apart, so a window minimum repeats at
the distance q.  Both are selected, and nothing equal lies between them, because k words that
cover a period occur in a run at distances that are multiples of q only.  So each run has a pair of
neighbouring equal minimizers at its period in one scale.  Pairs at another distance are dropped;
the others are extended word by word on both sides, which also rejects any collision of hashes.
Periods up to ``DIRECT`` leave no room for windows and are found by direct scans of that lag.  A stretch
that comes out with several periods has the smallest of them.

A task handles some documents at a time (``PART_BYTES`` of text, or one longer text) as one array of
word numbers, the longest document first, so that a scale works on the documents that are long enough
for it.  Words are numbered exactly, by a table of the part's distinct words.  Rows never leave
their task: there is no shuffle.  Two different groups of k words in one part share a 64-bit hash
with a probability of about 1e-7 a part; only then could a run be missed.

Defined results: a null text is an empty one; texts without words have no runs and an empty
collapsed text.  Rows may repeat, ids may be null, and an empty table gives an empty result.  A very
long text is one task's work: 8 bytes for each of its words, about ten times over.  Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.functions.regex import let

SHORTEST, PERIODS = 24, 3
DIRECT = SHORTEST // PERIODS
PART_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18


def scales(longest: int) -> list[tuple[int, int, int]]:
    """(low, k, window) of each scale that a document of ``longest`` words can need."""
    out, low = [], DIRECT
    while PERIODS * (low + 1) <= longest:
        k = low + low // 2
        out.append((low, k, 2 * (low + 1) - k + 1))
        low = k
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * _ODD + right)


class _Hashes:
    """Hashes of k consecutive words at every place of a prefix, by doubling."""

    def __init__(self, words: np.ndarray):
        self.size, self.at = 1, _mix(words.view(np.uint64) * _ODD + _M1)

    def of(self, k: int, n: int) -> np.ndarray:
        """For rising k and prefixes of ``n`` words that do not grow."""
        self.at = self.at[:n - self.size + 1]
        while 2 * self.size <= k:
            self.at = _joined(self.at[:-self.size], self.at[self.size:])
            self.size *= 2
        return self.at if k == self.size else _joined(self.at[:self.size - k], self.at[k - self.size:])


def _windows(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``size`` consecutive values."""
    have = 1
    while 2 * have <= size:
        values = best(values[:-have], values[have:])
        have *= 2
    return values if have == size else best(values[:have - size], values[size - have:])


def _selected(values: np.ndarray, window: int) -> np.ndarray:
    """Places whose value is the smallest of at least one window that holds them."""
    least = _windows(values, window, np.minimum)
    edge = np.zeros(window - 1, values.dtype)
    return np.flatnonzero(_windows(np.concatenate([edge, least, edge]), window, np.maximum) == values)


def _same(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or back (-1) equal the word ``lag`` later."""
    n, size, limit = 0, 64, (len(words) - lag - at if step == 1 else at + 1)
    while n < limit:
        size = min(size, limit - n)
        a = at + n if step == 1 else at - n - size + 1
        differ = words[a:a + size] != words[a + lag:a + lag + size]
        if differ.any():
            return n + int(np.argmax(differ if step == 1 else differ[::-1]))
        n, size = n + size, 2 * size
    return n


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in documents that lie one after another in ``words``, each
    followed by a number that occurs nowhere else; ``lengths`` (without that number) must fall."""
    ends = np.cumsum(lengths + 1)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, length: int, period: int) -> None:
        if length >= max(SHORTEST, PERIODS * period):
            found[start, length] = min(period, found.get((start, length), period))

    def prefix(length: int) -> int:
        """Words of the documents with at least ``length`` words."""
        n = int(np.searchsorted(-lengths, -length, "right"))
        return int(ends[n - 1]) if n else 0

    n = prefix(SHORTEST)
    for lag in range(1, DIRECT + 1 if n else 0):
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = words[:n - lag] == words[lag:n]
        edges = np.flatnonzero(np.diff(same))
        begin, length = edges[::2], edges[1::2] - edges[::2] + lag
        for k in np.flatnonzero(length >= SHORTEST).tolist():
            keep(int(begin[k]), int(length[k]), lag)
    hashes = _Hashes(words[:n]) if n else None
    for low, k, window in scales(int(lengths[0]) if len(lengths) else 0):
        n = prefix(PERIODS * (low + 1))
        values = hashes.of(k, n)
        places = _selected(values, window)
        order = places[np.argsort(values[places], kind="stable")]
        lag = np.diff(order)
        pairs = np.flatnonzero((lag > low) & (lag <= k) & (values[order[1:]] == values[order[:-1]]))
        begin, lag = order[pairs], lag[pairs]
        by = np.lexsort((begin, lag))
        last, end = 0, -1
        for at, q in zip(begin[by].tolist(), lag[by].tolist()):
            if q == last and at < end:
                continue  # inside the stretch just extended
            forth, back = _same(words, at, q, 1), _same(words, at - 1, q, -1) if at else 0
            last, end = q, at + forth
            keep(at - back, back + forth + q, q)
    return sorted((start, length, period) for (start, length), period in found.items())


def _numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words, the text cut at white space so that few words are objects at a time."""
    out, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + _CHUNK, len(text)))
        end = cut.start() if cut else len(text)
        words = text[at:end].split()  # on exactly the ASCII white space
        out.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _collapsed(numbers: np.ndarray, spelled: list[bytes]) -> bytes:
    parts = (numbers[a:a + _CHUNK].tolist() for a in range(0, len(numbers), _CHUNK))
    return b" ".join(b" ".join(map(spelled.__getitem__, p)) for p in parts)


def _part(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its runs as rows of start, length and period, and its words without repeats."""
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    numbers = [_numbers(t, vocabulary) for t in texts]
    lengths = np.array([len(x) for x in numbers], np.int64)
    order = np.argsort(-lengths, kind="stable")
    pieces: list[np.ndarray] = []
    for place, k in enumerate(order.tolist()):
        pieces += [numbers[k], np.array([-1 - place])]
    words = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    begins = np.cumsum(lengths[order] + 1) - lengths[order] - 1
    runs = np.array(find_runs(words, lengths[order]), np.int64).reshape(-1, 3)
    del words, pieces
    of = order[np.searchsorted(begins, runs[:, 0], "right") - 1] if len(runs) else np.zeros(0, np.int64)
    first = np.zeros(len(texts), np.int64)
    first[order] = begins
    runs[:, 0] -= first[of]
    spelled = list(vocabulary)
    by_text = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[by_text], np.arange(len(texts) + 1))
    all_runs, collapsed = [], []
    for k, x in enumerate(numbers):
        own = runs[by_text[edges[k]:edges[k + 1]]]
        if len(own):
            depth = np.zeros(len(x) + 1, np.int64)
            np.add.at(depth, own[:, 0] + own[:, 2], 1)
            np.add.at(depth, own[:, 0] + own[:, 1], -1)
            x = x[np.cumsum(depth[:-1]) == 0]
        all_runs.append(own)
        collapsed.append(_collapsed(x, spelled))
    return all_runs, collapsed


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``runs`` (by start, then period) and ``collapsed``: the words outside of what the
    runs repeat, with one space between them."""
    kind = dict(docs.dtypes)[id_col]
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
                runs, collapsed = _part(texts.slice(begin, end - begin).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.concatenate(runs)
                items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(struct))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin),
                    pa.ListArray.from_arrays(pa.array(offsets), items),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ], names=[id_col, "runs", "collapsed"])
                begin = end

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, runs {RUNS}, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_planted_runs(text: Column, id_column: Column) -> Column:
    """``text`` with a run up to its end in a tenth of the documents, chosen by id: what a test of
    recall needs.  Word i becomes word a + (i - a) % p; a and p follow from the id."""
    h = F.crc32(id_column.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        other = lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.transform(words, other))).otherwise(F.lit(""))

    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull()
    return F.when(chosen, let(F.regexp_extract_all(text, F.lit(WORD), 0), planted)).otherwise(text)
