"""Language of a text by prediction by partial matching.

Each language has a tree of byte contexts up to ``order`` bytes.  A byte is coded in the longest
context of the text so far that the language knows; if it never followed that context, an escape
is coded and the next shorter context is tried, down to a uniform code of all bytes (method C: a
context seen t times with q different followers gives a follower seen n times n/(t+q), and the
escape q/(t+q)).  The trees are frozen after training, so that the code length of a byte is a fixed
function of the bytes before it, and the language with the shortest exact code for the whole text
wins.  Its posterior probability, all languages being as likely, is the score.

Trees come from a sample of about ``sample_rows`` labelled documents for each language, whole texts
chosen by a hash of the id; that bound keeps them small enough for every worker.  Texts are lower
case, and every ASCII byte that is no letter counts as a space.

Defined results: ``und`` and 0.0 for a null text and for one without letters, and for every text
if no language was learned.  Ties go to the first language by code point.  Rows may repeat, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.llm.memory import hold

ORDER = 3
SAMPLE_ROWS = 400
MOST_BITS = 6.5  # a uniform code has 8; the languages learned take 2 to 4
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PIECE = 1 << 17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(5)) == 0, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether any character is of a Unicode category L*; numbers and number forms are none."""
    return any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each place, as one number; places from ``size`` - 1 on."""
    out = np.zeros(len(data) - size + 1, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[k:len(data) - size + 1 + k]
    return out


class Lookup:
    """Row of a key in a table, by a bijective mix and its leading bits; -1 if absent."""

    def __init__(self, keys: np.ndarray):
        mixed = self.mix(keys)
        self.order = np.argsort(mixed)
        self.mixed = mixed[self.order]
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        self.first = np.searchsorted(mixed[self.order] >> self.shift, edges).astype(np.int64)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))

    def find(self, keys: np.ndarray) -> np.ndarray:
        mixed = self.mix(keys)
        top = (mixed >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, mixed = at[left], end[left], mixed[left]
        while len(left):
            hit = self.mixed[at] == mixed
            out[left[hit]] = self.order[at[hit]]
            on = ~hit & (at + 1 < end)
            left, at, end, mixed = left[on], at[on] + 1, end[on], mixed[on]
        return out


@dataclass
class Level:
    """Contexts of one length with their next byte, of all languages together: the code length of
    each for every language, and by context the length of an escape (0 where it is unknown)."""

    cost: np.ndarray
    escape: np.ndarray
    keys: np.ndarray
    contexts: np.ndarray

    def __post_init__(self) -> None:
        self.of_key, self.of_context = Lookup(self.keys), Lookup(self.contexts)


class Model:
    def __init__(self, languages: list[str], levels: list[Level]):
        self.languages, self.levels, self.order = languages, levels, len(levels) - 1

    @classmethod
    def fit(cls, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        """``counts`` by order: gram, number of the language, times seen."""
        levels: list[Level] = []
        for order, (gram, language, times) in enumerate(counts):
            keys, place = np.unique(gram, return_inverse=True)
            seen = np.zeros((len(keys), len(languages)))
            np.add.at(seen, (place, language), times)
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = (np.zeros((len(contexts), len(languages))) for _ in range(2))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
                known = np.log2((total + kinds)[of]) - np.log2(seen)
            below = np.full((len(keys), len(languages)), 8.0)
            if order:
                below = _cost(levels, order - 1, keys & np.uint64((1 << 8 * order) - 1))
            cost = np.where(seen > 0, known, escape[of] + below)
            levels.append(Level(cost, escape, keys, contexts))
        return cls(languages, levels)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each folded text in each language; a text begins after ``order`` spaces.  Long
        texts are coded in pieces that each know the bytes before them."""
        out = np.zeros((len(texts), len(self.languages)))
        waiting, held = [], 0

        def flush() -> None:
            data = np.frombuffer(b"".join(context + part for _, context, part in waiting), np.uint8)
            costs, at = _cost(self.levels, self.order, grams(data, self.order + 1)), 0
            for row, _, part in waiting:
                out[row] += costs[at:at + len(part)].sum(0)
                at += self.order + len(part)

        for row, text in enumerate(texts):
            for begin in range(0, len(text), _PIECE):
                context = text[begin - self.order:begin] if begin else b" " * self.order
                waiting.append((row, context, text[begin:begin + _PIECE]))
                held += len(waiting[-1][2])
                if held >= _PIECE:
                    flush()
                    waiting, held = [], 0
        if waiting:
            flush()
        return out


def _cost(levels: list[Level], order: int, keys: np.ndarray) -> np.ndarray:
    """Code lengths of the last byte of each gram of ``order`` + 1 bytes."""
    level = levels[order]
    row = level.of_key.find(keys)
    out = level.cost[np.maximum(row, 0)] if len(level.cost) else np.zeros((len(keys), level.cost.shape[1]))
    missing = np.flatnonzero(row < 0)
    if len(missing):
        lower = keys[missing]
        context = level.of_context.find(lower >> np.uint64(8))
        escape = np.where((context >= 0)[:, None], level.escape[np.maximum(context, 0)], 0.0) if len(level.escape) else 0.0
        below = _cost(levels, order - 1, lower & np.uint64((1 << 8 * order) - 1)) if order else 8.0
        out[missing] = escape + below
    return out


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Contexts with their next byte, by language: order, gram, times seen in the batch."""
    names = ["lang", "level", "gram", "times"]
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            parts = [np.frombuffer(b" " * order + folded(t), np.uint8) for g, t in zip(langs, texts) if g == lang and t]
            for level in range(order + 1):
                found = [grams(p[order - level:], level + 1) for p in parts if len(p) > order]
                if not found:
                    continue
                gram, times = np.unique(np.concatenate(found), return_counts=True)
                columns = [pa.array([lang] * len(gram)), pa.array([level] * len(gram), pa.int32()), pa.array(gram.view(np.int64)), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled ``docs``.  What reaches the driver is the trees of the bounded sample."""
    labelled = docs.where(F.col(lang_col).isNotNull())
    sizes = labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Model([], [])
    whole = 1 << 40
    keep = {r[0]: min(whole, -(-sample_rows * whole // r[1])) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])[F.col(lang_col)]
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(whole)) < limit)
    counts = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _count(batches, order), "lang string, level int, gram bigint, times bigint"
    ).groupBy("lang", "level", "gram").agg(F.sum("times").alias("times")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    langs = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    level, gram, times = (counts.column(c).to_numpy() for c in ("level", "gram", "times"))
    found = [(gram[level == o].astype(np.uint64), langs[level == o], times[level == o]) for o in range(order + 1)]
    return Model.fit(languages, found) if languages else Model([], [])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``bits``: the mean code length of a byte."""
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "lang_pred", "score", "bits"]
    judge = _judge(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = judge()
        for batch in batches:
            best, score, bits = known(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=names)

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double, bits double")


def identified(docs: DataFrame, model: Model, text_col: str = "text", most_bits: float = MOST_BITS) -> DataFrame:
    """The documents in a learned language, with all their columns.  Those judged ``und`` go, and
    those that even the best language codes in more than ``most_bits`` a byte.  Only texts go to
    Python and only verdicts come back; nothing is joined or shuffled."""
    judge = _judge(docs, model)

    @F.arrow_udf("boolean")
    def keeps(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = judge()
        for part in texts:
            best, _, bits = known(part)
            yield pa.array([b != "und" and x <= most_bits for b, x in zip(best, bits)], pa.bool_())

    return docs.where(keeps(F.col(text_col)))


def _judge(docs: DataFrame, model: Model) -> Callable:
    """For a task: a function of a column of texts that gives the best language of each, its
    probability, and its code length a byte."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, [(x.cost, x.escape, x.keys, x.contexts) for x in model.levels]))

    def judge() -> Callable:
        hold("language", {})
        languages, tables = shared.value
        known = Model(languages, [Level(*t) for t in tables])

        def of(column: pa.Array) -> tuple[list[str], list[float], list[float]]:
            best, score, mean = ["und"] * len(column), [0.0] * len(column), [0.0] * len(column)
            for at in range(0, len(column), 256):
                texts = column.slice(at, 256).to_pylist()
                rows = [i for i, t in enumerate(texts) if languages and t and has_letter(t)]
                if not rows:
                    continue
                raw = [folded(texts[i]) for i in rows]
                bits = known.code_lengths(raw)
                more = bits - bits.min(1, keepdims=True)
                sure = 1 / np.exp2(-np.minimum(more, 1000)).sum(1)
                for i, k, s, b, t in zip(rows, bits.argmin(1).tolist(), sure.tolist(), bits.min(1).tolist(), raw):
                    best[at + i], score[at + i], mean[at + i] = languages[k], s, b / len(t)
            return best, score, mean

        return of

    return judge
