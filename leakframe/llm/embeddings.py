"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine of at least 0.98 is a distance of at most 0.2.  Each of
``TABLES`` tables quantises ``HASHES`` Gaussian projections in steps of ``WIDTH``; a pair at 0.98
meets in at least one table with a probability of 0.999, closer pairs with more.  Vectors that are
equal in every component form one class and are compared once.

Pairs of a bucket are compared inside tasks, in double precision.  A large bucket is dealt over pairs of
blocks of ``BLOCK`` classes, so none is cut.  A pair that meets in several tables counts in the
first of them, which both sides know from their keys.  Tasks return sums of links by vector and a
spanning forest of their links, never the pairs.

Defined results: vectors without a label, null, empty or zero vectors and those with a null or
non-finite component link with nothing and are their own component.  Vectors of different lengths
do not link.  Rows without an id are counted as links of others but never give a component its
name.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.components import components
from leakframe.llm.storage import stored
from leakframe.llm.streams import grouped

TABLES, HASHES, WIDTH = 24, 10, 1.25
BLOCK = 1024
COSINE = 0.98


def table_keys(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table, as a 64-bit number without the table or the label."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * hashes))
    shift = rng.uniform(0, width, tables * hashes)
    cells = np.floor((unit @ directions + shift) / width).astype(np.int64).reshape(len(unit), tables, hashes)
    odd = rng.integers(1, 1 << 62, (tables, hashes), dtype=np.int64) | 1
    return (cells * odd).sum(2)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    left, edges = near.any(1), []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            reached = near[frontier].any(0) & left
            frontier = np.flatnonzero(reached)
            left &= ~reached
            edges += [(root, int(v)) for v in frontier]
    return edges


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, block: int = BLOCK, seed: int = 7,
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` for every row."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(valid, F.lit(False)))
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
    # a class without an id cannot be named: it gets a number of its own below all ids' use
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                x = np.stack([flat[edges[i]:edges[i + 1]] for i in own.tolist()])
                x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
                keys[own] = table_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes, width, seed)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.ListArray.from_arrays(np.arange(0, tables * len(keys) + 1, tables, dtype=np.int32), pa.array(keys.reshape(-1))),
            ], names=["node", "keys"])

    keyed = stored(classes.select("node", "v").mapInArrow(hashed, "node bigint, keys array<bigint>"), "keys")
    hits = keyed.join(classes.select("node", "label", F.size("v").alias("d")), "node").select(
        "node", "label", "d", F.posexplode("keys").alias("t", "key")
    ).select("node", "t", F.xxhash64("label", "d", "t", "key").alias("bucket"))
    sizes = hits.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    met = hits.join(sizes, "bucket").withColumn("blocks", blocks)
    met = met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("bucket", F.least("mine", "with"), F.greatest("mine", "with")).alias("task"), "t", "node",
        (F.col("mine") == F.col("with")).alias("same"), (F.col("mine") <= F.col("with")).alias("upper"),
    )
    payload = classes.select("node", "m", "v").join(keyed, "node")
    dealt = met.join(payload, "node").select("task", "t", "same", "upper", "node", "m", "v", "keys")
    dealt = dealt.repartition("task").sortWithinPartitions("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
        for group in grouped(batches, "task"):
            n = group.num_rows
            upper, same = (group.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "same"))
            node, m = group.column("node").to_numpy(), group.column("m").to_numpy()
            t = int(group.column("t")[0].as_py())
            x = group.column("v").chunk(0).flatten().to_numpy().reshape(n, -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys = group.column("keys").chunk(0).flatten().to_numpy().reshape(n, -1)
            near = x @ x.T >= cosine
            if not same[0]:  # two blocks: pairs inside a block belong to another task
                near &= upper[:, None] != upper[None, :]
            np.fill_diagonal(near, False)
            for k in range(t):
                near &= keys[:, k][:, None] != keys[:, k][None, :]
            if not near.any():
                continue
            linked = np.flatnonzero(near.any(1))
            edges = forest(near)
            a = np.concatenate([node[linked], node[[i for i, _ in edges]]])
            b = [None] * len(linked) + node[[j for _, j in edges]].tolist()
            sums = np.concatenate([(near[linked] * m[None, :]).sum(1), np.zeros(len(edges), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(sums)], schema=schema)

    found = stored(dealt.mapInArrow(compare, "node bigint, other bigint, links bigint"), "links")
    sums = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL"), "node", "other")
    names = classes.select("node", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = names.groupBy("component").agg(F.min("rep").alias("name"))
    named = names.join(least, "component").select("node", "name").join(sums, "node", "left")
    told = classes.select("label", "v", "m", "node").join(named, "node").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "name"
    )
    linked = good.join(told, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("id", "links", "name")
    alone = rows.where(~F.coalesce(valid, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("name"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("name").alias("component_id"),
        F.coalesce(F.col("id") == F.col("name"), F.lit(False)).alias("kept"),
    )
