"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# AQE coalesces small shuffle partitions, splits skewed join partitions and swaps a join to
# broadcast only after it has seen the real size of a side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # batches to Python by bytes: ten thousand long texts would be too many
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session and give its workers the package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    Functions are pickled by reference, so workers must be able to import the package wherever
    they start.  Spark copies the archive from the driver to each executor.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="leakframe-")) / "leakframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names; a local one only in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="leakframe-checkpoint-")
    if named is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where several outputs read one expensive intermediate (detected matches): it is
    computed once, and a lost executor costs a re-read instead of a new scan of all text.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut_lineage`` for wide rows: a compressed table in the shared folder, read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 64 * 1024 * 1024


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` behind a checkpoint, and the bytes of its rows."""
    kept = cut_lineage(df)
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes")
    return kept, kept.agg(size).first()["bytes"] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if it is measured to be small, else leave the join to a shuffle.

    For joins of a narrow table with wide text: by the time AQE knows the narrow side, the text
    has been shuffled.  The narrow side is checkpointed, its bytes are summed, and only a side
    below the limit is broadcast, so that the text stays where it is.
    """
    kept, size = measured(df)
    return F.broadcast(kept) if size <= limit else kept


_BUILT: dict[tuple[str, str], dict[str, Column]] = {}


def built_once(key: str, build: Callable[[], dict[str, Column]]) -> dict[str, Column]:
    """Columns that refer to their inputs by name are the same for every plan, so they are
    built once per application: some hold hundreds of expressions."""
    context = SparkContext._active_spark_context
    full_key = (context.applicationId if context else "", key)
    if full_key not in _BUILT:
        _BUILT[full_key] = build()
    return _BUILT[full_key]
