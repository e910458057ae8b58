import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from leakframe.llm import hash_tree

ROOT = hash_tree.tree()


def brute(key, node, path=""):
    """The descent in Python."""
    while node.children:
        def drawn(c, at=path):
            u = (int(hashlib.md5(f"{at}/{c.name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            return math.log(u) / c.weight
        won = max((c for c in node.children if c.weight > 0), key=drawn)
        node, path = won, f"{path}/{won.name}"
    return node.shard


def assigned(spark, root, keys, grown=None):
    docs = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string")
    return {r.doc_id: r for r in hash_tree.assign(docs, root, grown).collect()}


def test_the_tree_by_brute_force(spark):
    grown = hash_tree.with_region(ROOT)
    assert ROOT.shards() == 24 and grown.shards() == 25
    out = assigned(spark, ROOT, range(3000), grown)
    assert all(r.shard == brute(k, ROOT) and r.grown_shard == brute(k, grown) for k, r in out.items())
    moved = [r for r in out.values() if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {24} and 70 < len(moved) < 180
    counts = collections.Counter(r.shard for r in out.values())
    assert sorted(counts) == list(range(24)) and min(counts.values()) > 70 and max(counts.values()) < 190
    for shard in range(24):
        own = sorted((r.doc_id, r.slot) for r in out.values() if r.shard == shard)
        assert [s for _, s in own] == list(range(len(own)))
    again = hash_tree.with_region(grown)
    later = assigned(spark, grown, range(3000), again)
    assert {r.grown_shard for r in later.values() if r.shard != r.grown_shard} == {25}


def test_weights_and_where_documents_move(spark):
    heavy = ROOT.changed("region0/rack1/shard2", 5.0)
    assert heavy.weight == 28 and heavy.children[1] == ROOT.children[1]
    out = assigned(spark, ROOT, range(4000), heavy)
    target = 6
    into = [r for r in out.values() if r.shard != r.grown_shard]
    share = sum(r.grown_shard == target for r in out.values()) / len(out)
    assert abs(share - 5 / 28) < 0.03
    # a row moves into the region, rack or shard whose weight grew, never between others
    for r in into:
        assert r.grown_shard // 12 == 0
        if r.shard // 12 == 0:
            assert r.grown_shard // 4 == 1
            if r.shard // 4 == 1:
                assert r.grown_shard == target
    gone = ROOT.changed("region1/rack0/shard0", 0)
    out = assigned(spark, ROOT, range(2000), gone)
    assert not any(r.grown_shard == 12 for r in out.values())
    assert all(r.shard // 12 == 1 for r in out.values() if r.shard != r.grown_shard)
    with pytest.raises(ValueError):
        hash_tree.choose(F.lit("k"), hash_tree.tree(weight=0.0))
    with pytest.raises(ValueError):
        ROOT.changed("region9/rack0/shard0", 1.0)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "ä€😀"), (3, "ä€😀"), (None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("shard", "slot", "id", "row", "_value", "_range", "size"):
        docs = docs.withColumn(name, F.lit("z"))
    out = hash_tree.assign(docs, ROOT).collect()
    texts = sorted((t or "").encode() for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len(t) + 8, zlib.crc32(t)) for t in texts)
    assert all(r.grown_shard is None and r.shard == brute("" if r.doc_id is None else r.doc_id, ROOT) for r in out)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.assign(docs.limit(0), ROOT).count() == 0


def test_a_hot_id_is_numbered_over_ranges(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = hash_tree.assign(docs, ROOT).where(F.col("shard") == brute(7, ROOT)).collect()
    assert sorted(r.slot for r in out) == list(range(len(out))) and len(out) > 1334


def test_files_hold_the_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(200)], "doc_id long, text string, source string")
    hash_tree.write_shards(docs, ROOT, str(tmp_path / "shards"), files=6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.text, r.source, r.shard) for r in back.collect()) == [(i, f"text {i}", "s", brute(i, ROOT)) for i in range(200)]
