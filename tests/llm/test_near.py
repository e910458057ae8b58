import random

import numpy as np
import pytest

from leakframe.llm import embeddings, minhash


def sets_of(text, words):
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return set()
    size = min(words, len(found))
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)}


def components_of(nodes, linked):
    """Smallest node reachable."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_brute(rows, words, percent):
    sets = [(i, sets_of(t, words)) for i, t in rows if i is not None]
    links = [
        (a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    return components_of({i for i, _ in sets}, links), {i: len(s) for i, s in sets}


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  TWO"), (7, "İ ß one"), (8, "i ß one")]
    for i in range(10, 60):  # one large group, each with a few edits: many are near, some are not
        text = list(base)
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(text)))
    chain = [rnd.choice(vocabulary) for _ in range(200)]
    for i in range(60, 75):  # each near its neighbour only
        rows.append((i, " ".join(chain)))
        for _ in range(3):
            chain[rnd.randrange(len(chain))] = rnd.choice(vocabulary)
    for i in range(75, 110):
        rows.append((i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60)))))
    rows += [(200 + i, rows[40][1]) for i in range(30)]  # copies
    return rows


@pytest.mark.parametrize("words,percent,block", [(3, 85, 1024), (5, 80, 7)])
def test_near_documents_by_brute_force(spark, words, percent, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component long").repartition(6)
    got = {r.doc_id: r for r in minhash.near_groups(docs, words=words, percent=percent, block=block).collect()}
    component, size = near_brute(rows, words, percent)
    assert {i: r.component_id for i, r in got.items()} == component
    assert {i: r.n_shingles for i, r in got.items()} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_documents_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "only here"), (None, None), (6, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs, words=3, percent=85).collect()), key=repr)
    assert got == sorted([(None, 4, 5, False), (5, 4, 5, True), (5, 4, 5, True), (None, 1, None, False), (None, 0, None, False), (6, 1, 6, True)], key=repr)
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    s = minhash.signatures([a, b, a], 512)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 300 / 500) < 0.08


def vectors():
    rng = np.random.default_rng(2)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        rows.append((n, None if v is None else [None if x is None else float(x) for x in v], label))
        n += 1

    for _ in range(60):
        add(rng.standard_normal(16), int(rng.integers(3)))
    center = rng.standard_normal(16)
    for k in range(60):  # a hot group, some of it near only to some
        add(center + rng.standard_normal(16) * 0.12 * np.linalg.norm(center) / 4, 1)
    for k in range(20):
        add(center, 1)
    for v in (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [1.0] * 9):
        add(v, 1)
    add(center, None)
    add(center * 1e-200, 1)
    return rows


def test_near_vectors_by_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, g, 0) for i, v, g in rows], "vec_id long, embedding array<double>, label int, node int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame, block=16, tables=60).collect()}
    good = [
        (i, np.array(v) / np.abs(v).max(), g) for i, v, g in rows
        if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = [
        (a, b) for k, (a, x, g) in enumerate(good) for b, y, h in good[:k]
        if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    ]
    assert len(links) > 300
    component = components_of({r[0] for r in rows}, links)
    count = {i: 0 for i in component}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert got == {i: (count[i], c, i == c) for i, c in component.items()}
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_first_shared_table_counts_a_pair_once(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.001 * i], 3) for i in range(6)] + [(None, [1.0, 0.0005], 3)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect()}
    assert got == {None: (6, 0)} | {i: (6, 0) for i in range(6)}


def test_an_id_on_two_texts_loses_no_link(spark):
    """Id 1 stands on two texts; documents 2 and 3 are each near one of them."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame(
        [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "else"), (None, a)], "doc_id bigint, text string"
    )
    got = minhash.near_groups(docs, words=3, percent=85).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [
        (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)
    ]


def test_a_text_of_its_own_stays_when_its_id_is_dropped_elsewhere(spark):
    """Id 5 stands on a copy of document 1, which goes, and on a text of its own, which stays;
    columns with the names that the stage uses are kept as they are."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a), (5, a + " more"), (5, "a text of its own"), (None, a), (6, None), (7, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id bigint, text string, _gone int, _hash int, node int, digest int")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted(
        [(0, a), (1, a), (5, "a text of its own"), (6, ""), (7, "")]
    )
