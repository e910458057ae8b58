import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leakframe.llm import exact

ROWS = [
    (1, "a b", "x"), (2, "a  b", "x"), (3, "ab\n", "x"), (4, "ab", "x"), (5, None, "x"), (6, "", "x"), (7, " \t\n\x0b\f\r", "x"),
    (8, "é b", "x"), (9, "éb ", "x"), (10, "b\u00a0c", "x"), (11, "bc", "x"), (12, "w" * 200_000, "x"), (13, "w" * 100_000 + " " + "w" * 100_000, "x"),
    (None, "solo", "x"), (None, "ab", "x"), (14, "ab", None), (14, "ab", "x"), (15, "other", "x"), (15, "ab", "x"),
]
SCHEMA = "doc_id long, text string, kept string"  # an extra column whose name is that of a result


def brute(rows):
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc, keep, len(members), doc == keep, hashlib.sha256(content.encode()).hexdigest()) for doc, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("several", [False, True])
def test_groups(spark, several):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    # two hex digits as the digest: different texts must not merge
    digest = (lambda c: F.substring(exact.sha256(c), 1, 1)) if several else exact.sha256
    got = exact.exact_groups(docs, salts=3, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_shared_digest_is_refused(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="one digest"):
        exact.exact_groups(docs, digest=lambda c: F.lit("same"), several=False).collect()


def test_what_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact.without_copies(docs)
    assert got.columns == docs.columns
    stay = sorted((r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or "")[:9]) for r in got.collect() if r.doc_id is not None)
    assert stay == [(2, "ab"), (7, ""), (8, "éb"), (10, "b\u00a0c"), (11, "bc"), (13, "w" * 9), (15, "other")]
    assert [r.text for r in got.where("doc_id IS NULL").collect()] == ["solo"]
    twice = spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (2, "b", "p")], SCHEMA)
    assert sorted(r.doc_id for r in exact.without_copies(twice).collect()) == [1, 2]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(docs).count() == 0 and exact.without_copies(docs).count() == 0
