"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leakframe.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path below ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    return ["_" * next(n for n in range(len(taken) + 1) if ("_" * n + name).lower() not in taken) + name for name in names]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and by column: later readers load only
    what they need, and a lost executor costs a re-read.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
