import os
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from leakframe.llm import queries
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_near import near_brute
from tests.test_entry import SF, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_result_in_sql(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, row)) for row in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr) == want


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"op3_token_files", "op5_language", "op10_packed", "op11_whitened", "op13_periodic_runs"}
    assert set(queries.QUERIES) <= set(names)


def test_pipeline_by_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    english, german = [["the", "and", "with", "thing", "river"], ["der", "und", "mit", "schön", "über"]]
    rows = []
    for i in range(60):
        words = [rnd.choice(english if i % 2 else german) + rnd.choice("abcdefgh") for _ in range(150)]
        rows.append((i, " ".join(words), "en" if i % 2 else "de", f"s{i % 4}", 0))
    for i in range(60, 70):  # near copies and exact copies
        words = rows[i - 60][1].split()
        words[3] = "changed"
        rows.append((i, " ".join(words), *rows[i - 60][2:]))
        rows.append((i + 100, rows[i - 60][1] + "\n", *rows[i - 60][2:]))
    rows += [(500, None, "en", "s0", 0), (501, "123 456", "en", "s0", 0), (502, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r[0]: r for r in rows}

    def step(k, docs):
        out = corpus_pipeline.stored(corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)), "stage")
        assert k == 4 or out.columns == docs.columns
        return out, sorted(r.doc_id for r in out.collect())

    docs, ids = step(0, docs)
    left = {k: v for k, v in left.items() if k < 500}
    assert ids == sorted(left)
    docs, ids = step(1, docs)
    groups = {}
    for r in left.values():
        groups.setdefault("".join(r[1].split()), []).append(r)
    left = {r[0]: r for g in groups.values() for r in [min(g, key=lambda x: (-len(x[1]), x[0]))]}
    assert ids == sorted(left)
    docs, ids = step(2, docs)
    component, _ = near_brute([(r[0], r[1]) for r in left.values()], 5, 80)
    left = {k: v for k, v in left.items() if component[k] == k}
    assert ids == sorted(left) and len(ids) < 65
    docs, ids = step(3, docs)
    size, _, taken = mix_brute([(r[0], r[1], r[3], None) for r in left.values()], share=1.0)
    words = {k: len(v[1].split()) for k, v in left.items()}
    assert ids == sorted(k for k in left for _ in range(taken[k] // words[k]))
    docs, packed = step(4, docs)
    assert sorted(set(packed)) == sorted(set(ids))
    whole = {}
    for r in docs.collect():
        whole[r.sequence_id] = whole.get(r.sequence_id, 0) + r.length
    assert max(whole.values()) <= 1024


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_by_itself_bounds_its_batches(spark, name):
    rows = [(i, "the river and the thing " * 4000 + str(i), "en", "s0", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        sizes = docs.select("text").mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [pc.sum(pc.binary_length(b.column(0))).as_py()]}) for b in batches), "n long"
        ).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(s.n for s in sizes) == sum(len(r[1]) for r in rows) and max(s.n for s in sizes) <= 5 << 20
