"""The value functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_CREATE = "CREATE OR REPLACE TEMPORARY FUNCTION "
FUNCTIONS = (
    "shannon_entropy(v STRING) RETURNS DOUBLE RETURN CASE WHEN v = '' THEN 0D ELSE -aggregate("
    "transform(array_distinct(filter(split(v, ''), c -> c <> '')), c -> (length(v) - length(replace(v, c, ''))) / length(v)), "
    "0D, (total, p) -> total + p * log2(p)) END",
    "mask_secret(v STRING) RETURNS STRING RETURN CASE WHEN coalesce(v, '') = '' THEN '****' "
    "WHEN length(v) <= 8 THEN concat(left(v, 2), '****') ELSE concat(left(v, 8), '...', right(v, 4)) END",
)


def register(spark: SparkSession) -> None:
    """``shannon_entropy(value)`` and ``mask_secret(value)``, the report form, for ``spark.sql``."""
    for function in FUNCTIONS:
        spark.sql(_CREATE + function)
