"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make all coordinates: ``sigma`` scatters the shingles once,
and coordinate k is the least value of ``pi`` shifted circularly by k.  ``BANDS`` bands of ``ROWS``
coordinates bucket the documents; the chance that a pair at the threshold shares no bucket is below
1e-4 at 0.8 and below 1e-6 at 0.85.

Documents with equal shingle sets form a class before anything is compared, so copies cost one row.
Then every link that can join two components is decided on the full sets:

1. each class is compared with the first class of its largest bucket (as many pairs as classes);
2. buckets whose members lie in one component by now have nothing left to decide.  In each of the
   others all pairs are compared inside tasks, block by block, as products of membership matrices;
   only a spanning forest of the links between components leaves a task.

No bucket is cut: a large one is dealt over pairs of blocks of ``BLOCK`` classes.

Defined results: a null text, an empty text or one of white space alone has no shingles and links
with nothing.  Shorter texts than ``words`` are one shingle.  Rows without an id are not linked
through; they report the component of their text's class, or null.  Rows that repeat an id and a
text agree; an id that stands on several texts is a document for each of them, and no text's links
are lost: classes have numbers of their own and are told apart by the digest of their shingles.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.components import components
from leakframe.llm.memory import hold, trim
from leakframe.llm.storage import stored
from leakframe.llm.streams import grouped
from leakframe.operators.bloom import Bloom

BANDS, ROWS = 24, 5
BLOCK = 1024
REMEMBERED = 200_000
_CHUNK = 1 << 16

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    """64-bit hash of each word, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:  # frequent words come early
            self[word] = value
        return value


_WORDS = _Words()


def _own_memory() -> None:
    hold("words", _WORDS)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles.  bytes.lower() and bytes.split() know ASCII only, which is
    what the words are defined by."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    mixed = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        mixed = _mix64(mixed * _A + h[k:len(h) - size + 1 + k])
    return np.unique(mixed)


def _sigma(x: np.ndarray) -> np.ndarray:
    """Permutation of the 32-bit numbers, of the folded shingles."""
    y = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    y = (y ^ (y >> np.uint32(16))) * np.uint32(0x7FEB352D)
    y = (y ^ (y >> np.uint32(15))) * np.uint32(0x846CA68B)
    return y ^ (y >> np.uint32(16))


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The other permutation, in place."""
    for multiplier, shift in ((0x9E3779B1, 15), (0x85EBCA77, 13)):
        np.multiply(x, np.uint32(multiplier), out=x)
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
    return np.multiply(x, np.uint32(0xC2B2AE3D), out=x)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Row per set; sets may not be empty.  Works through the sets in pieces that fit a cache."""
    out = np.empty((len(sets), coordinates), np.uint32)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (end == begin or held + len(sets[end]) <= _CHUNK):
            held += len(sets[end])
            end += 1
        base = _sigma(np.concatenate(sets[begin:end]))
        starts = np.cumsum([0] + [len(s) for s in sets[begin:end - 1]])
        x, spare = np.empty_like(base), np.empty_like(base)
        for k in range(coordinates):
            np.subtract(base, np.uint32(k), out=x)
            out[begin:end, k] = np.minimum.reduceat(_pi(x, spare), starts)
        begin = end
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _A, parts.shape[:2]).copy()
    for r in range(rows):
        key = _mix64(key * _C + parts[:, :, r])
    return key.view(np.int64)


def digest(shingle_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id``, 64-bit hash of the text, number of shingles, digest of the set, and the band keys."""
    schema = pa.schema([
        ("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_memory()
        for batch in batches:
            ids, texts, hashes = batch.columns
            for at in range(0, len(ids), 512):
                sets = [shingles(t.as_py(), words) for t in texts[at:at + 512]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), np.int64)
                if full:
                    keys[full] = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([
                    ids[at:at + 512], hashes[at:at + 512], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(map(digest, sets), pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                ], schema=schema)
            trim()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(
        sign, "id bigint, text_hash bigint, n bigint, digest binary, bands array<bigint>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node`` and its sorted shingles for the ``wanted`` classes (``node``, ``digest``, and ``id``
    of a document), read again.  A Bloom filter of bounded size picks the texts where they are read, so
    no text is shuffled, however many are wanted; other texts, also of the same ids, are told by their
    digest and left out."""
    schema = pa.schema([("digest", pa.binary()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(t.as_py(), words) for t in batch.column(0)[at:at + 512]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(map(digest, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary()),
                ], schema=schema)
            trim()

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    again = Bloom(wanted.select("id"), "id").mark(texts, F.col("id"), "may").where("may").select("text")
    found = again.mapInArrow(sets, "digest binary, shingles binary").dropDuplicates(["digest"])
    return found.join(wanted.select("node", "digest"), "digest").select("node", "shingles")


def linked(inter: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """``total``: sum of both sizes."""
    return 100 * inter >= percent * (total - inter)


def _products(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Intersection sizes of the first ``rows`` sets with all sets.  Only shingles that occur twice
    can count; their membership matrix is multiplied in strips of bounded width."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = owner[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((rows, len(sets)), np.float32)
    width = 4096
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [begin, begin + width])
        member = np.zeros((len(sets), width), np.float32)
        member[owner[a:b], column[a:b] - begin] = 1
        inter += member[:rows] @ member.T
    return inter.astype(np.int64)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number reachable from each of 0 to ``size`` - 1 over the links (a, b)."""
    root = np.arange(size)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` and ``text_hash`` (xxhash64 of the text) for every row."""
    signs = stored(signed(docs, id_col, text_col, words, bands, rows), "signatures")
    classes = signs.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands")  # equal sets have equal bands
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    hits = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = hits.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).where("size > 1")
    members = stored(hits.join(sizes, "bucket").select("bucket", "node", "size", "lead"), "buckets")

    # 1. each class with the first class of its largest bucket
    best = F.max(F.struct("size", (-F.col("lead")).alias("lead")))
    pairs = members.where(F.col("node") != F.col("lead")).groupBy("node").agg(best.alias("b"))
    pairs = pairs.select("node", (-F.col("b.lead")).alias("lead"))
    wanted = classes.join(members.select("node").distinct(), "node").select("node", "digest", F.col("rep").alias("id"))
    sets = stored(full_sets(docs, wanted, id_col, text_col, words), "sets", "none")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                keep.append(bool(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sets.select("node", F.col("shingles").alias("own"))
    other = sets.select(F.col("node").alias("lead"), F.col("shingles").alias("other"))
    links = pairs.join(own, "node").join(other, "lead").select("node", "lead", "own", "other").mapInArrow(verify, "a bigint, b bigint")
    links = stored(links, "links1")

    # 2. buckets that still hold several components, each distinct set of members once
    parts = components(links, "a", "b")
    placed = members.join(parts, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("part")
    )
    open_ = placed.groupBy("bucket").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("node"),
    ).where("low < high").groupBy("size", "sum", "node").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = placed.join(open_, "bucket").withColumn("blocks", blocks).withColumn("mine", mine).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    dealt = dealt.select(
        F.xxhash64("bucket", F.least("mine", "with"), F.greatest("mine", "with")).alias("task"),
        (F.col("mine") <= F.col("with")).alias("upper"), "node", "part",
    ).join(sets, "node").repartition("task").sortWithinPartitions("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            upper = group.column("upper").to_numpy(zero_copy_only=False)
            order = np.concatenate([np.flatnonzero(upper), np.flatnonzero(~upper)])
            node, part = (group.column(c).to_numpy()[order] for c in ("node", "part"))
            if len(np.unique(part)) < 2:
                continue
            raw = group.column("shingles")
            sets_ = [np.frombuffer(raw[i].as_py(), np.uint64) for i in order.tolist()]
            n = np.array([len(s) for s in sets_])
            top = int(upper.sum())
            near = linked(_products(sets_, top), n[:top, None] + n[None, :], percent) & (part[:top, None] != part[None, :])
            i, j = np.nonzero(near)
            if len(i):
                # a spanning forest says the same as all links between components: no more rows than members
                names, first, own = np.unique(part, return_index=True, return_inverse=True)
                root = _roots(len(names), own[i], own[j])
                moved = np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(node[first[moved]]), pa.array(node[first[root[moved]]])], names=["a", "b"])

    more = dealt.select("task", "upper", "node", "part", "shingles").mapInArrow(compare, "a bigint, b bigint")
    joined = components(links.unionByName(more), "a", "b")
    placed = classes.select("digest", "rep", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("rep").alias("name"))
    named = placed.join(names, "component").select("digest", "name")
    out = signs.select("id", "text_hash", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), "text_hash",
    )
