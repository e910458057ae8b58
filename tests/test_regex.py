import random
import re

import pytest
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import regex as rx
from leakframe.functions import text
from tests import models

FAMILIES = {
    k: v for k, v in vars(fv).items()
    if isinstance(v, list) and v and isinstance(v[0], str)
    and k.startswith(("FP_", "FAST_", "ENTROPY_VALUE", "URL_", "TEST_PATH", "ONE_WORD", "CREDENTIAL"))
    and k not in ("FAST_SKIP_EXTENSIONS", "FAST_LITERALS", "FAST_GENERIC_STEMS")
}


def test_families_agree_with_python(spark):
    rng = random.Random(3)
    values = [models.random_text(rng, rng.randint(1, 30)) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    both = [(k, case) for k in FAMILIES for case in (True, False)]
    cols = [rx.hits(F.col("v"), FAMILIES[k], ignore_case=case).alias(f"{k}_{case}") for k, case in both]
    rows = df.select("v", *cols).collect()
    wrong = []
    for row in rows:
        for k, case in both:
            want = any(re.search(p, row.v, re.I if case else 0) for p in FAMILIES[k])
            if row[f"{k}_{case}"] != want:
                wrong.append((k, case, row.v))
    assert wrong == []


def test_dialect_translation():
    assert rx.to_java(r"(?P<my_key>a)(?P=my_key)") == r"(?<gmyZkey>a)\k<gmyZkey>"
    assert rx.to_java(r"a{,3}b{2}") == "a{0,3}b{2}"
    assert rx.to_java(r"{x}") == r"\{x\}"
    assert rx.to_java(r"[[&]") == r"[\[\&]"


@pytest.mark.parametrize("pattern", [r"\w+@\w+", r"[\w.]+\s", r"^\s+$", r"\d{2,}", r"[^\w\s]", r"a.b", r"\bé"])
def test_unicode_classes(spark, pattern):
    rng = random.Random(5)
    values = [models.random_text(rng, 12) for _ in range(300)] + ["٣٣", "a\nb", "x²@y", "\x1c　"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", rx.hits(F.col("v"), pattern).alias("hit")).collect():
        assert row.hit == bool(re.search(pattern, row.v, re.I)), row.v


def test_guard_never_hides_a_hit():
    assert rx.guard([r"\w+\|\|\(\w+=\{\}\)", r"typeof\s+\w+"]) is not None
    assert rx.guard([r"\w+", r"a"]) is None


def test_strip_and_entropy(spark):
    rng = random.Random(9)
    values = [models.random_text(rng, rng.randint(0, 40)) for _ in range(200)] + ["  x\x1c ", "aaaaaaaaaa", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", text.python_strip(F.col("v")).alias("s"), text.entropy(F.col("v")).alias("e")).collect():
        assert row.s == row.v.strip()
        assert row.e == pytest.approx(models.entropy(row.v))


def test_known_entropies(spark):
    row = spark.range(1).select(
        text.entropy(F.lit("aaaaaaaaaa")).alias("low"), text.entropy(F.lit("aB3xK9mP2qR5tW8yZ")).alias("high")
    ).first()
    assert row.low == 0 and row.high > 4.0
