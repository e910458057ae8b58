import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakframe.llm import periodic, queries


def brute_runs(words):
    """Every period by a scan of its lag; a stretch with a smaller period is that period's run."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def mixed_words(rnd, n, kinds, repeats):
    words = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(repeats):
        a, p = rnd.randrange(max(1, n)), rnd.randrange(1, max(2, n // 3))
        for i in range(a + p, min(n, a + p * rnd.randrange(2, 8) + rnd.randrange(p))):
            words[i] = words[i - p]
        if n and rnd.random() < 0.5:
            words[rnd.randrange(n)] = rnd.randrange(kinds)
    return [b"w%d" % w for w in words]


def check(texts):
    runs, kept = periodic._part([b" ".join(t) for t in texts])
    for words, own, text in zip(texts, runs, kept):
        want = brute_runs(words)
        assert [tuple(r) for r in own.tolist()] == want
        assert text == collapsed(words, want)


def test_runs_of_all_periods():
    rnd = random.Random(1)
    for q in [1, 2, 7, 8, 9, 12, 13, 18, 19, 27, 28, 40, 41, 60, 61, 99, 200, 333]:
        unit = [b"u%d" % i for i in range(q)]
        for length in {max(24, 3 * q), max(24, 3 * q) - 1, max(24, 3 * q) + 5, 4 * q + 23}:
            around = mixed_words(rnd, 30, 1000, 0)
            check([around + [unit[i % q] for i in range(length)] + around])
    assert brute_runs([b"a"] * 24) == [(0, 24, 1)]


def test_random_texts_of_few_words():
    rnd = random.Random(2)
    for trial in range(150):
        check([mixed_words(rnd, rnd.choice([0, 1, 23, 24, 60, 300]), rnd.choice([1, 2, 3, 50]), rnd.randrange(6)) for _ in range(rnd.randrange(1, 5))])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 12), st.integers(0, 8)), max_size=5))
def test_nested_repeats(parts):
    words = []
    for unit, times, more in parts:
        words += unit * times + unit[:more]
    check([[b"x%d" % w for w in words]])


def test_the_words_of_strings_with_few_repeats():
    """Fibonacci and Thue-Morse words have repeats at every scale, the second none of three periods."""
    fib, thue = [[b"a"], [b"a", b"b"]], [0]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    check([fib[-1], [b"t%d" % x for x in thue]])


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "_CHUNK", 64)
    check([mixed_words(random.Random(3), 900, 5, 6)])


def test_defined_results(spark):
    run = " ".join(["a b c"] * 10)
    rows = [(1, None, 0), (2, "", 0), (3, " \t\x0b\n", 0), (4, run, 0), (4, run, 0), (None, run + "\x0b\x0cd", 0), (6, "ä b  x\x1cy", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("collapsed", F.lit(1)).withColumn("n", F.lit(1))
    out = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse_runs(docs).collect()), key=repr)
    assert out == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 30, 3)], "a b c"), (4, [(0, 30, 3)], "a b c"),
        (None, [(0, 30, 3)], "a b c d"), (6, [], "ä b  x\x1cy"),
    ], key=repr)
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def brute_query(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] * 10 ** 12 // r[2], r[0], r[2]), default=(None, None, None))
    said = "".join("%d,%d,%d\n" % r for r in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def test_query_by_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, b" ".join(mixed_words(rnd, rnd.choice([0, 5, 40, 90]), 4, rnd.randrange(3))).decode()) for i in range(300)]
    rows += [(i, None) for i in range(300, 340)] + [(None, rows[9][1]), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in out.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((brute_query(*r) for r in rows), key=repr)


def test_scales_leave_room_for_two_windows():
    for low, k, window in periodic.scales(10 ** 6):
        assert window >= 1
        for q in (low + 1, k):
            assert window + k - 1 + q <= periodic.PERIODS * q
    assert np.all(periodic._windows(np.arange(9), 4, np.maximum) == np.arange(3, 9))
