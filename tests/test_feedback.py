"""LIKE joins through the piece index, folded counts, and the classifier's evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leakframe.operators import feedback, patterns


def like(text, pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def joined(spark, texts, wanted):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, n int")
    asked = spark.createDataFrame([(p, k) for k, p in enumerate(wanted)], "p string, k int")
    return sorted((r.n, r.k) for r in patterns.like_join(df, "t", asked, "p").collect())


def test_a_thousand_patterns_that_begin_with_a_wildcard(spark):
    rnd = random.Random(1)
    texts = list({"".join(rnd.choice("abc[]:+1") for _ in range(rnd.randrange(0, 12))) for _ in range(300)})
    wanted = ["%" + "".join(rnd.choice("abc[]:+1%_") for _ in range(rnd.randrange(1, 6))) for _ in range(1000)]
    want = sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(wanted) if like(t, p))
    assert joined(spark, texts, wanted) == want and len(want) > 3000


def test_patterns_of_every_kind(spark):
    texts = ["", "a", "ab", "abc", "a%b", "a_b", "a\\b", "x\ny", "ÄÖ😀", "aaa", None]
    wanted = ["%", "_", "__", "_%", "%_%_%", "", "a", "%a", "a%", "a\\%b", "a\\_b", "a\\\\b", "%\n%", "_😀", "Ä_😀", "%aa%", "nowhere%", "%b_", None, "a\\%%"]
    want = sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(wanted) if t is not None and p is not None and like(t, p))
    assert joined(spark, texts, wanted) == want
    assert joined(spark, [], wanted) == [] == joined(spark, texts, [])


def test_the_join_has_no_shared_empty_key(spark):
    """Each pattern joins on a piece that its matches hold, so a wildcard in front is no hot key."""
    df = spark.createDataFrame([("%x:12]",), ("%abc%",)], "p string")
    assert sorted(tuple(sorted(r[0])) for r in df.select(patterns.required_pieces(F.col("p"))).collect()) == sorted(
        tuple(sorted({s[i:i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1)})) for s in ("x:12]", "abc")
    )


SCHEMA = "value string, value_hash string, path string, secret_type string, severity string, is_true_positive boolean"


@pytest.fixture(scope="module")
def reviews(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(900):
        value = rnd.choice(["hunter2", "AKIA12345678", "test", "sha256/abc=", "http://example.com", "", "ghp_0aB", None])
        path = rnd.choice(["a/b.py", "x/certificate.yml", "Dockerfile", "", None])
        rows.append((value, "%02x" % rnd.randrange(256), path, rnd.choice(["password", None]), "high", rnd.choice([True, False, None])))
    return spark.createDataFrame(rows, SCHEMA).withColumn("value_hash", F.sha2(F.coalesce("value", F.lit("")), 256)).cache()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_folded_counts_equal_plain_counts(reviews):
    items = feedback.anonymise(reviews)
    shapes = feedback.fold_shapes(reviews)
    assert shapes.agg(F.sum("reviews")).first()[0] == 900 and shapes.count() < 30
    same(feedback.totals(shapes), feedback.totals(items))
    same(feedback.top_names(feedback.fold_dimensions(reviews)), feedback.dimension_counts(items))
    same(feedback.known_false_positives(shapes, 2, 0.1), feedback.known_false_positives(items, 2, 0.1))
    same(feedback.top_shapes(shapes), feedback.top_shapes(items))
    same(feedback.rate_by_hint(feedback.fold_hints(reviews)), feedback.rate_by_hint(items))
    known = items.select(F.col("value_pattern").alias("pattern"), F.lit(0.5).alias("confidence")).distinct().limit(2)
    same(feedback.new_shapes(shapes, known, 1), feedback.new_shapes(items, known, 1))
    same(feedback.known_effectiveness(shapes, known), feedback.known_effectiveness(items, known))
    same(feedback.shape_alerts(shapes, known, 1, 10.0), feedback.shape_alerts(items, known, 1, 10.0))
    features = feedback.fold_features(reviews)
    plain = feedback.classifier_features(items).groupBy(*feedback.FEATURES, "label").agg(F.count(F.lit(1)).alias("n"))
    same(features.groupBy(*feedback.FEATURES, "label").agg(F.sum("reviews").alias("n")), plain)


def test_classifier_on_held_out_values(spark):
    """Rejected values are short words in test files; the held-out ones were never seen."""
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        fake = rnd.random() < 0.4
        value = "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(4, 9))) if fake else "".join(rnd.choice("abc123") for _ in range(rnd.randrange(16, 40)))
        wrong = rnd.random() < 0.03  # reviewers err
        rows += [(value, None, "t/test_x.py" if fake else "src/x.py", "password", "high", fake == wrong)] * rnd.randrange(1, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("value_hash", F.sha2("value", 256))
    judged, counts = feedback.evaluate(feedback.fold_features(df), trees=10, min_precision=0.9)
    parts = {r.held_out: r for r in counts.collect()}
    assert set(parts) == {True, False}
    for part in parts.values():
        assert part.precision >= 0.9 and part.recall >= 0.9
    assert sum(r.caught + r.missed + r.lost + r.kept for r in parts.values()) == len(rows)
    assert parts[True].caught + parts[True].kept > 700
    assert judged.where("rejected").count() > 0 and judged.count() < 1200
    one_side = judged.groupBy("held_out").agg(F.sum("reviews").alias("n")).collect()
    assert {r.held_out: r.n for r in one_side} == {k: v.caught + v.missed + v.lost + v.kept for k, v in parts.items()}


def test_no_precise_threshold_rejects_nothing(spark):
    rows = [("abcd" + "x" * (i % 7), "a/b.py", "password", bool(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "value string, path string, secret_type string, is_true_positive boolean").withColumn("value_hash", F.sha2("value", 256))
    judged, counts = feedback.evaluate(feedback.fold_features(df), trees=3, min_precision=1.01)
    assert judged.where("rejected").count() == 0 and all(r.caught == 0 and r.precision is None for r in counts.collect())
    table = feedback.confusion(spark.createDataFrame([(0.9, 0.0, 8), (0.9, 1.0, 2), (0.5, 0.0, 2), (0.5, 1.0, 8)], "false_positive_chance double, label double, reviews bigint"))
    assert sorted((r.threshold, r.caught, r.lost, r.precision, r.recall) for r in table.collect()) == [(0.5, 10, 10, 0.5, 1.0), (0.9, 8, 2, 0.8, 0.8)]


def test_reviews_fold_before_a_shuffle(spark):
    """A value at many paths of one class leaves a task as one row, and a null path has a class."""
    word = F.concat(F.lit("word"), (F.col("id") % 1).cast("string"))
    reviews = spark.range(4_000, numPartitions=2).select(
        word.alias("value"), F.sha2(word, 256).alias("value_hash"), F.lit("password").alias("secret_type"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".py"))).alias("path"), F.lit(True).alias("is_true_positive"),
    )
    folded = feedback.fold_features(reviews)
    assert sorted((r.file_type, r.reviews) for r in folded.collect()) == [("python", 3_000), ("unknown", 1_000)]
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [value" in line]
    assert grouped and not any("path" in line.split("]")[0] for line in grouped)
