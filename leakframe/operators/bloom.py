"""Bloom filters as small tables: which keys may be in a set that is too large to send around.

A filter is a table of at most ``MOST`` rows of 4 KiB.  A key belongs to one row (``bucket``) and sets
``BITS`` bits of it, so a test is one join with a broadcast table of bounded size and a few bit
operations.  A key of the set is always found; another one seldom, and more often the fuller the
filter is.  The size follows the number of keys up to its bound, beyond which only errors grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.session import cut_lineage

BUCKET_BITS = 8 * 4096  # of bitmap_construct_agg
BITS = 4
BITS_PER_KEY = 12
MOST = 4096  # 16 MiB


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(buckets)).cast("int")


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(BUCKET_BITS)) for i in range(BITS)]


class Bloom:
    """Filter of the keys in a column, which may repeat; null is no key."""

    def __init__(self, keys: DataFrame, column: str, most: int = MOST):
        kept = keys.where(F.col(column).isNotNull())
        self.buckets = max(1, min(most, -(-kept.count() * BITS_PER_KEY // BUCKET_BITS)))
        bits = kept.select(_bucket(F.col(column), self.buckets).alias("bucket"), F.explode(F.array(*_bits(F.col(column)))).alias("bit"))
        self.table = cut_lineage(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")))

    def mark(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """``df`` with the boolean ``out``: whether the key may be in the set.  No row moves."""
        rows = df.withColumn("_bucket", F.coalesce(_bucket(key, self.buckets), F.lit(-1)))
        found = rows.join(F.broadcast(self.table), F.col("_bucket") == F.col("bucket"), "left")
        byte = lambda bit: F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # the highest bit asked for is moved to the lowest place of its byte
        isset = [F.floor(byte(bit) / F.pow(F.lit(2), bit % 8)) % 2 == 1 for bit in _bits(key)]
        whole = F.coalesce(F.col("bitmap").isNotNull() & key.isNotNull() & reduce(lambda a, b: a & b, isset), F.lit(False))
        return found.withColumn(out, whole).drop("_bucket", "bucket", "bitmap")
