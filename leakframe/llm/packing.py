"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document is its ids and the end id.  Only documents above the capacity are cut, into pieces of
exactly the capacity; their first piece may be shorter.  Full pieces are sequences of their own.
All others are dealt to islands of about ``island_size`` pieces.  On each island a task evolves a
small population of packings: crossover copies the well-filled bins of one parent whole, adds the
bins of the other parent that share no piece with them (so no piece is doubled), and best-fits the
displaced pieces, largest first.  After each epoch bins that are full, up to ``slack`` ids, are
settled.  The elite of the rest migrates: bins travel whole, dealt anew over fewer islands, where
they are a member of the first population, while poorly filled bins are broken up.  The last epoch
settles everything.  Islands are bounded and dealt by a hash of unique piece numbers, so no group
grows with the data.

Defined results: a null or empty text is one piece that holds the end id.  Rows that repeat an id
are packed once for each row.  An empty table gives no rows.  Reruns over the same rows agree on
every piece; the numbers of the sequences depend on how rows lie in partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.storage import stored
from leakframe.llm.tokens import encoder

CAPACITY = 1024
ISLAND_SIZE = 2048
EPOCHS = 3
POPULATION = 4
GENERATIONS = 6
SLACK = 2

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# ------------------------------------------------------------------ documents to pieces
def cut(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids."""
    if total <= capacity:
        return [total]
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, number, place in its document, length, checksum, and on request
    its ids as little-endian unsigned 32-bit integers."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        if with_ids:
            arrow["ids"] = pa.binary()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, stop, ids, counts in encoder(tokenizer).parts(batch.column(1)):
                raw, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                for doc, n in zip(batch.column(0).slice(first, stop - first).to_pylist(), counts.tolist()):
                    start = 0
                    for number, length in enumerate(cut(n + 1, capacity)):
                        part = raw[4 * (at + start):4 * min(at + start + length, at + n)]
                        last = start + length == n + 1
                        crc = zlib.crc32(end, zlib.crc32(part)) if last else zlib.crc32(part)
                        row = (doc, number, start, length, crc)
                        rows.append((*row, bytes(part) + end if last else bytes(part)) if with_ids else row)
                        start += length
                    at += n
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, arrow.values())], names=list(arrow)
                )

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(cut_batches, schema)


# ------------------------------------------------------------------ one island
class Bins:
    """Packing under construction; finds the fullest bin that still takes a piece in O(1) steps
    through a bit set of the gaps that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.members, self.gaps = capacity, [], []
        self.by_gap: dict[int, list[int]] = {}
        self.present = 0

    def _file(self, b: int) -> None:
        gap = self.gaps[b]
        if gap:
            self.by_gap.setdefault(gap, []).append(b)
            self.present |= 1 << gap

    def add(self, members: list[int], filled: int) -> None:
        self.members.append(members)
        self.gaps.append(self.capacity - filled)
        self._file(len(self.gaps) - 1)

    def best_fit(self, item: int, size: int) -> None:
        fits = self.present >> size
        if not fits:
            self.add([item], size)
            return
        gap = size + (fits & -fits).bit_length() - 1
        waiting = self.by_gap[gap]
        b = waiting.pop()
        if not waiting:
            self.present &= ~(1 << gap)
        self.members[b].append(item)
        self.gaps[b] = gap - size
        self._file(b)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean square of the fill)."""
        full = 1 - np.array(self.gaps) / self.capacity
        return -len(self.gaps), float((full * full).mean()) if len(full) else 0.0


def crossover(first: Bins, second: Bins, sizes: list[int], order: np.ndarray, share: float) -> Bins:
    """Inject the best-filled bins of ``first`` whole, then bins of ``second`` without a piece that
    is already there; best-fit the rest in ``order``."""
    child, taken = Bins(first.capacity), set()
    gaps = np.array(first.gaps)
    for b in np.argsort(gaps, kind="stable")[: int(len(gaps) * share)].tolist():
        child.add(list(first.members[b]), first.capacity - first.gaps[b])
        taken.update(first.members[b])
    for members, gap in zip(second.members, second.gaps):
        if 32 * gap <= second.capacity and taken.isdisjoint(members):
            child.add(list(members), second.capacity - gap)
            taken.update(members)
    for item in order.tolist():
        if item not in taken:
            child.best_fit(item, sizes[item])
    return child


def evolve(sizes: list[int], groups: list[list[int]], capacity: int, seed: int, population: int, generations: int) -> Bins:
    """The fittest packing found.  ``sizes`` are in a fixed order; ``groups`` are immigrant bins."""
    rng = np.random.default_rng(seed)
    length = np.array(sizes)

    def packed(order: np.ndarray, whole: list[list[int]] = ()) -> Bins:
        one, taken = Bins(capacity), set()
        for members in whole:
            one.add(list(members), sum(sizes[i] for i in members))
            taken.update(members)
        for item in order.tolist():
            if item not in taken:
                one.best_fit(item, sizes[item])
        return one

    falling = np.argsort(-length, kind="stable")
    orders = [falling] + [np.argsort(-length * rng.uniform(0.8, 1.0, len(length)), kind="stable") for _ in range(population - 1)]
    members = [packed(o) for o in orders]
    if groups:
        members.append(packed(falling, groups))
    least = -(-int(length.sum()) // capacity)
    for _ in range(generations):
        members.sort(key=Bins.fitness, reverse=True)
        if len(members[0].gaps) <= least:  # no packing can have fewer
            break
        a, b = rng.permutation(len(members))[:2] if len(members) > 1 else (0, 0)
        a, b = min(a, b), max(a, b)
        order = np.argsort(-length * rng.uniform(0.9, 1.0, len(length)), kind="stable")
        child = crossover(members[a], members[b], sizes, order, float(rng.uniform(0.3, 0.8)))
        other = crossover(members[b], members[a], sizes, falling, float(rng.uniform(0.3, 0.8)))
        members = members[: population - 1] + [child, other]
    return max(members, key=Bins.fitness)


# ------------------------------------------------------------------ epochs
def settler(epoch: int, capacity: int, population: int, generations: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The task of one island in an epoch."""

    def settle(island: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_uid"], ascending=[False, True], ignore_index=True)
        sizes, groups = rows["length"].tolist(), {}
        for i, (has, bin_) in enumerate(zip(rows["_bin"].notna().tolist(), rows["_travel"].tolist())):
            if has:
                groups.setdefault(bin_, []).append(i)
        key = int(island[0])
        best = evolve(sizes, list(groups.values()), capacity, key * 31 + epoch, population, generations)
        number, offset, filled = (np.zeros(len(rows), np.int64) for _ in range(3))
        for b, (members, gap) in enumerate(zip(best.members, best.gaps)):
            at = 0
            for i in members:
                number[i], offset[i], filled[i] = b, at, capacity - gap
                at += sizes[i]
        rows["sequence_id"] = (epoch << 56) + (key << 24) + number
        return rows.assign(offset=offset, _filled=filled)

    return settle


def pack(
    found: DataFrame, capacity: int = CAPACITY, island_size: int = ISLAND_SIZE, epochs: int = EPOCHS,
    population: int = POPULATION, generations: int = GENERATIONS, slack: int = SLACK,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of at most ``capacity``."""
    numbered = stored(found.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    own = found.columns
    full = numbered.where(F.col("length") >= capacity).select(
        *own, (-F.col("_uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    loose = numbered.where(F.col("length") < capacity).withColumn("_bin", F.lit(None).cast("bigint"))
    settled = [full]
    columns = loose.columns
    kinds = {f.name: f.dataType.simpleString() for f in loose.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", _travel bigint, _island bigint, sequence_id bigint, offset bigint, _filled bigint"
    for epoch in range(epochs):
        islands = -(-loose.count() // island_size)
        if not islands:
            break
        last = epoch == epochs - 1 or islands == 1

        # a bin that travels goes whole: its pieces are dealt by the number of the bin
        loose = loose.withColumn("_travel", F.coalesce("_bin", "_uid"))
        island = F.pmod(F.xxhash64("_travel", F.lit(epoch)), F.lit(islands))
        after = stored(loose.withColumn("_island", island).groupBy("_island").applyInPandas(settler(epoch, capacity, population, generations), schema), "island")
        done = F.lit(True) if last else F.col("_filled") >= capacity - slack
        settled.append(after.where(done).select(*own, "sequence_id", "offset"))
        if last:
            break
        elite = F.when(F.col("_filled") * 32 >= 31 * capacity, F.col("sequence_id"))
        loose = after.where(~done).withColumn("_bin", elite).select(*columns)
    packed = settled[0]
    for one in settled[1:]:
        packed = packed.unionByName(one)
    return packed


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ids, from packed pieces that carry ``ids``.  A group holds at most
    the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
