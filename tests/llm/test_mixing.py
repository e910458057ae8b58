import hashlib
import random
import re

import pytest

from leakframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def factor(sizes, rest):
    """Inclusion min(1, c n) with ``rest`` words expected: the longest are certain one by one."""
    left, sizes = rest, sorted(sizes, reverse=True)
    for i, n in enumerate(sizes):
        c = left / sum(x * x for x in sizes[i:])
        if c * n < 1:
            return c
        left -= n
    return 0.0


def brute(rows, weights=(5, 2, 1), share=1.5, cap=2.0, seed="mix"):
    sized = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s, _ in rows]
    sources = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, free = {}, share * sum(size.values()), set(sources)
    while True:  # reshare the excess until none is above
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * size[s]}
        if not over:
            break
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = {}
    for s in sources:
        certain = int(target[s] // size[s]) if size[s] else 0
        rest = target[s] - certain * size[s]
        c, queue = factor([n for _, n, x in sized if x == s and n], rest), []
        for d, n, x in sized:
            if x == s:
                taken[d] = certain * n
                u = (int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                f = c * n
                if f >= 1:
                    queue.append((0.0, d, n))
                elif f > 0:
                    queue.append((u / (1 - u) / (f / (1 - f)), d, n))
        words = 0
        for _, d, n in sorted(queue):
            words += n
            if 2 * words - n <= 2 * rest:
                taken[d] += n
    return size, target, taken


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        source = rnd.choice(["a"] * 6 + ["b", "B", "é", None, "zz"])
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 400])), source, "x"))
    return rows + [(1000, None, "only empty", None), (1001, "tiny", "alone", None), (1002, "x " * 90_000, "huge", None)]


@pytest.mark.parametrize("slots", [4, 1024])
def test_mixture_by_brute_force(spark, slots):
    rows = corpus()
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), slots=slots).collect()}
    size, target, taken = brute(rows)
    for d, _, s, _ in rows:
        assert got[d].source_size == size[s] and got[d].target == pytest.approx(target[s]) and got[d].taken == taken[d]
        assert got[d].taken <= 2 * got[d].size and got[d].taken == got[d].copies * got[d].size


def test_weighted_documents_are_drawn_more(spark):
    rows = [(i, "w w", "s", str(9 if i % 2 else 1)) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, share=0.3, weight_col="target").collect()
    odd, even = (sum(r.copies for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert odd + even == 600 and odd > 3 * even


def test_rows_of_the_mix(spark):
    rows = [(1, "a b", "s", "p"), (2, "c", "s", None), (None, "d e f", None, None), (3, "", "t", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs, share=2.0)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "a b")] * 2 + [(2, "c")] * 2 + [(None, "d e f")] * 2, key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(7, "a b", "s", None)] * 10, SCHEMA)
    assert sum(r.taken for r in mixing.mix(same).collect()) == 30


def test_rows_on_a_cut_and_clashing_names(spark):
    """Null and repeated ids are told apart row by row; internal names may be columns."""
    rows = [(None if i % 3 else i, "one two three", "a" if i % 2 else "b", "t") for i in range(240)]
    rows += [(7, "w " * 5, "a", "t")] * 60
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("_copies", "_copy", "_id", "_key", "_of", "_q", "_number", "q", "cut", "size", "id", "source_key", "f", "rows", "_value", "a.b"):
        docs = docs.withColumn(name, mixing.F.lit(1))
    counted = mixing.mix(docs, share=0.7).collect()
    taken = mixing.mixed(docs, share=0.7)
    assert taken.columns == docs.columns
    words = [(r["source"], len(r["text"].split())) for r in taken.collect()]
    for source in ("a", "b"):
        target = {r.target for r in counted if r.source_size == sum(len(t.split()) for _, t, s, _ in rows if s == source)}
        assert abs(sum(n for s, n in words if s == source) - target.pop()) <= 5


def test_the_mix_joins_no_text(spark):
    docs = spark.createDataFrame([(i, "one two", "a", "t") for i in range(40)], SCHEMA)
    plan = mixing.mixed(docs, share=0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_inclusion_follows_size(spark):
    """Over many seeds a document is drawn about as often as its share says; the longest always."""
    sizes = [1, 2, 3, 5, 8, 8, 13, 21, 34, 55, 89, 144]
    rows = [(i, "w " * n, "s", None) for i, n in enumerate(sizes)]
    rest = 0.7 * sum(sizes)
    c = factor(sizes, rest)
    seeds = 400
    drawn = [0] * len(sizes)
    for seed in range(seeds):
        _, _, taken = brute(rows, share=0.7, seed=f"seed{seed}")
        for i in range(len(sizes)):
            drawn[i] += taken[i] > 0
    wanted = [min(1.0, c * n) for n in sizes]
    assert wanted[-1] == 1.0 and wanted[0] < 0.05 and drawn[-1] == seeds
    assert abs(sum(f * n for f, n in zip(wanted, sizes)) - rest) < 1e-9
    # the words of a sample are fixed to the nearest document, which bends the odds of the longest a little
    assert all(abs(d / seeds - f) < 0.16 for d, f in zip(drawn, wanted))
    assert drawn[0] < drawn[4] < drawn[7] < drawn[9]
    docs = spark.createDataFrame(rows, SCHEMA)
    for seed in ("seed1", "seed2"):
        got = {r.doc_id: r.taken for r in mixing.mix(docs, share=0.7, seed=seed).collect()}
        assert got == brute(rows, share=0.7, seed=seed)[2]
