import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# one or two per module; the driver compares all of them
CHECKED = [
    "match_positions", "scan_pages", "scan_configs", "json_location", "history_scanned_once", "first_files",
    "compare_summary", "lines_per_file", "redacted_text", "rewritten_files", "format_status", "feedback_valid",
    "shape_like_known", "requests_last_hour", "status_transitions", "env_template", "stream_scan",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return round(value, 6)
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


@pytest.mark.parametrize("name", CHECKED)
def test_same_result_in_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    answer = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, row)) for row in answer.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert got == want


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    own = set(entry.registered.QUERIES)
    queries, sql = {k: queries[k] for k in own}, {k: v for k, v in sql.items() if k in own}
    assert set(sql) <= set(queries) and len(queries) > 120
    # a trained model's predictions have no SQL; test_feedback.py holds them to a held-out part
    assert set(queries) - set(sql) == {"fp_classifier_predictions", "fp_classifier_confusion"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scan_plan_has_no_shuffle_of_text(spark, tmp_path):
    """Detection on a plain table is one narrow stage, and only needed columns are read."""
    from leakframe.operators import detect
    from leakframe.operators.paths import keep_scannable
    from leakframe.plans.tables import NO_ENTROPY, RULES

    spark.createDataFrame([("r", "a.txt", "x", 1, "junk")], "repo string, path string, content string, size_bytes bigint, extra string").write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t")).select("repo", "path", "content", "size_bytes")
    plan = detect.scan(keep_scannable(files, NO_ENTROPY), RULES, NO_ENTROPY)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "extra#" not in plan and "extra:" not in plan
    assert "LessThanOrEqual(size_bytes,500000)" in plan
