"""Structured Streaming forms of the operators.

Each function takes a streaming DataFrame and returns one, or a writer that is ready to start.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from leakframe import schemas
from leakframe.operators import detect, feedback, jobs
from leakframe.operators.paths import keep_scannable
from leakframe.operators.rules import Rule, ScanConfig

HOUR = "1 hour"


def scan_arriving(files: DataFrame, rules: list[Rule], config: ScanConfig | None = None) -> DataFrame:
    """Scan files as they arrive.  Stateless: output mode append."""
    config = config or ScanConfig()
    return detect.scan(keep_scannable(files, config), rules, config)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON or Parquet rows of ``schemas.FILES`` that arrive in a folder."""
    return spark.readStream.schema(schemas.FILES).parquet(path)


def running_counts(items: DataFrame) -> DataFrame:
    """Feedback counts by shape, file type, secret type and verdict; mode complete or update.

    State is one counter per (dimension, name, verdict), not per item."""
    dims = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("unknown")).alias("name"))
            for d in ("value_pattern", "file_type", "secret_type")
        ]
    )
    verdict = F.when(F.col("is_true_positive"), F.lit("true_positives")).otherwise(F.lit("false_positives"))
    return (
        items.select(F.inline(dims), verdict.alias("verdict"))
        .groupBy("dimension", "verdict", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def known_from_counts(counts: DataFrame, min_samples: int = 10, above: float = 0.8) -> DataFrame:
    """Known false positives from the running counts of the shape dimension."""
    is_fp = F.col("verdict") == "false_positives"
    return (
        counts.where(F.col("dimension") == "value_pattern")
        .groupBy(F.col("name").alias("pattern"))
        .agg(F.sum("n").alias("sample_count"), F.sum(F.when(is_fp, F.col("n")).otherwise(F.lit(0))).alias("_fp"))
        .where((F.col("sample_count") >= min_samples) & (F.col("_fp") / F.col("sample_count") > above))
        .select("pattern", F.round(F.col("_fp") / F.col("sample_count"), 2).alias("confidence"), "sample_count")
    )


def write_known(items: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the table of shape counts up to date; readers use ``known_table``.

    A batch brings the new counts of the shapes it changed; they are merged with the last version
    into a folder of their own, and one row added to the folder ``versions`` makes it the current
    one (a write of Spark is all or nothing).  Readers never see a folder that is written.  A batch
    that runs again after a failure before that row starts from the version before it; after that
    row it changes nothing.  One table belongs to one checkpoint; old versions stay."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = current_version(spark, path)
        if batch_id <= before:
            batch.write.format("noop").mode("overwrite").save()  # the counters must move on
            return
        changed = batch.where(F.col("dimension") == "value_pattern").persist()
        rows = changed
        if before >= 0:
            last = spark.read.schema(changed.schema).parquet(f"{path}/counts-{before}")
            rows = last.join(changed, ["dimension", "verdict", "name"], "left_anti").unionByName(changed)
        rows.write.mode("overwrite").parquet(f"{path}/counts-{batch_id}")
        publish_version(spark, path, batch_id)
        changed.unpersist()

    publish_version(items.sparkSession, path, -1)  # readers may come before the first batch
    return (
        running_counts(items).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(upsert)
    )


def current_version(spark: SparkSession, path: str) -> int:
    """The last version that was made current; -1 before the first."""
    return spark.read.schema("version bigint").parquet(f"{path}/versions").agg(F.max("version")).first()[0]


def publish_version(spark: SparkSession, path: str, version: int) -> None:
    """Make a written version the one that readers see."""
    spark.range(version, version + 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{path}/versions")


def known_table(spark: SparkSession, path: str, min_samples: int = 10, above: float = 0.8) -> DataFrame:
    """Known false positives of the current version that ``write_known`` published."""
    schema = "dimension string, verdict string, name string, n bigint"
    version = current_version(spark, path)
    if version < 0:
        return known_from_counts(spark.createDataFrame([], schema), min_samples, above)
    return known_from_counts(spark.read.schema(schema).parquet(f"{path}/counts-{version}"), min_samples, above)


def fresh(events: DataFrame, ts: str = "ts", now: Column | None = None) -> DataFrame:
    """Drop events more than an hour old or in the future; the watermark bounds later state.

    ``ts`` may be a timestamp without zone; watermarks need one with."""
    now = F.current_timestamp() if now is None else now
    hour = F.expr("INTERVAL 1 HOUR")
    at = F.col(ts).cast("timestamp")
    return events.withColumn(ts, at).withWatermark(ts, HOUR).where(
        (F.col(ts) <= now + hour) & (F.col(ts) >= now - hour)
    )


def hourly_requests(events: DataFrame, client: str = "client_id", ts: str = "ts", limit: int = 100) -> DataFrame:
    """Requests per client and hour with a flag above the limit; a metric, not the exact test."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, HOUR)
        .groupBy(F.window(ts, HOUR), client).agg(F.count(F.lit(1)).alias("requests"))
        .select(client, F.col("window.start").alias("hour"), "requests", (F.col("requests") > limit).alias("over_limit"))
    )


class RateLimit(StatefulProcessor):
    """Exact limit: a request counts only if it was allowed.

    The requests of a client in one batch may be any number, and they come in pieces that are not
    in the order of time.  Each piece is put away in the state store by time bucket; then the
    buckets are decided from the oldest on, a piece at a time, so that memory holds one piece, the
    times of allowed requests (``limit`` at most) and the candidates of one bucket.

    A bucket is no longer than the window, so whoever is allowed in it stays in the window to its
    end.  The k-th place comes free at a known time, and who takes it is among the first k
    requests from that time on: those are the candidates.  A second reading tells the rest."""

    def __init__(self, limit: int = 100, window_seconds: int = 3600):
        self.limit = limit
        self.window = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "us bigint")
        self.pieces = handle.getMapState("pieces", "bucket bigint, number bigint", "us array<bigint>, ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count: dict[int, int] = {}
        for frame in rows:
            for bucket, part in frame.groupby(frame["us"] // self.window):
                number = count.get(int(bucket), 0)
                self.pieces.updateValue((int(bucket), number), (part["us"].tolist(), part["request_id"].tolist()))
                count[int(bucket)] = number + 1
        kept = sorted(r[0] for r in self.seen.get())
        for bucket in sorted(count):
            names = [(bucket, number) for number in range(count[bucket])]
            allowed, kept = self._decide(names, kept)
            taken = set(allowed)
            for name in names:
                us, ids = self.pieces.getValue(name)
                self.pieces.removeKey(name)
                frame = pd.DataFrame({"client_id": key[0], "request_id": ids, "us": us})
                frame["allowed"] = [request in taken for request in zip(us, ids)]
                yield frame
        if kept:
            self.seen.put([(us,) for us in kept])
            self.handle.registerTimer((kept[-1] + self.window) // 1000 + 1)

    def _decide(self, names: list, kept: list[int]) -> tuple[list, list[int]]:
        """Allowed requests of a bucket, and the times that hold a place after it."""
        free = self.limit - len(kept)
        opens = [None] * free + [us + self.window for us in kept]
        first: dict[int | None, list] = {}  # the time a place comes free: the first requests from then on
        wanted = {at: k + 1 for k, at in enumerate(opens)}
        for name in names:
            piece = sorted(zip(*self.pieces.getValue(name)))
            for at, k in wanted.items():
                start = 0 if at is None else bisect_left(piece, (at, ""))
                if start < len(piece):
                    first[at] = sorted(first.get(at, []) + piece[start:start + k])[:k]
        allowed: list = []
        for request in sorted({r for held in first.values() for r in held}):
            if len(allowed) < self.limit and (opens[len(allowed)] is None or opens[len(allowed)] <= request[0]):
                allowed.append(request)
        used = max(len(allowed) - free, 0)
        return allowed, sorted(kept[used:] + [us for us, _ in allowed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [r[0] for r in self.seen.get() if r[0] + self.window > now]
        if kept:  # a later request set a later timer
            self.seen.put([(us,) for us in kept])
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int = 100, delay: str = HOUR) -> DataFrame:
    """Allowed or rejected, exactly, per client in time order.

    Needs client_id, request_id (unique for a client and time) and ts.  Uses the state store, so
    set the RocksDB provider.  No request is dropped: one that comes more than ``delay`` late is
    decided by the state that is left.  The state of a client ends with the window of its last
    allowed request, by a timer on the watermark.  Rows without ts or request_id are left out."""
    # the processor also starts in a process that has no added files, so it travels by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # the watermark moves the timers; ``us`` does not carry it, so late rows are not filtered
    at = F.col("ts").cast("timestamp")
    keyed = requests.withColumn("ts", at).withWatermark("ts", delay).select(
        F.col("client_id").cast("string").alias("client_id"),
        F.col("request_id").cast("string").alias("request_id"),
        F.unix_micros("ts").alias("us"),
    ).where(F.col("us").isNotNull() & F.col("request_id").isNotNull())
    return keyed.groupBy("client_id").transformWithStateInPandas(
        RateLimit(limit),
        outputStructType="client_id string, request_id string, us bigint, allowed boolean",
        outputMode="append",
        timeMode="eventTime",
    )


class Retained(StatefulProcessor):
    """The first row of a key; the key is forgotten when the retention is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.known.exists():
            self.known.update((True,))
            yield pd.DataFrame({"id": [key[0]]})
        for _ in rows:  # Spark wants the input read to its end; a piece at a time is held
            pass

    def close(self) -> None:
        pass


def first_within_retention(rows: DataFrame, id_col: str, hours: float) -> DataFrame:
    """Ids that were not delivered within the retention, once each (column ``id``).

    State is one flag per id with a time to live, so it holds one retention's ids and no more.
    With the trigger ``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false:
    Spark runs batches without data for clocks of its own, and would not come to an end."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.select(F.col(id_col).cast("string").alias("id")).groupBy("id").transformWithStateInPandas(
        Retained(int(hours * 3_600_000)), outputStructType="id string", outputMode="append", timeMode="processingTime"
    )


def dedup_events(events: DataFrame, ts: str = "created_at", delay: str = HOUR) -> DataFrame:
    """At-least-once delivery to once: one row per event id inside the watermark."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def deliver(
    outbox: DataFrame, publish: Callable[[DataFrame], DataFrame | None], dead: Callable[[DataFrame], None],
    checkpoint: str, max_retries: int = 5, update: Callable[[DataFrame], None] | None = None,
) -> DataStreamWriter:
    """Each batch: events below the retry limit to ``publish``, the rest to ``dead``.

    ``publish`` returns the events that arrived (column ``id``), or nothing if all did.  ``update``
    then gets the batch as it stands: arrived events are marked, the retries of the others rise."""

    def route(batch: DataFrame, _: int) -> None:
        batch.persist()
        waiting = batch.where(~F.col("published"))
        tried = waiting.where(F.col("retry_count") < max_retries)
        arrived = publish(tried)
        dead(waiting.where(F.col("retry_count") >= max_retries))
        if update is not None:
            update(jobs.after_publish(batch, tried if arrived is None else arrived, F.current_timestamp(), max_retries))
        batch.unpersist()

    return outbox.writeStream.option("checkpointLocation", checkpoint).foreachBatch(route)


def within_retention(rows: DataFrame, ts: str, hours: int, now: Column | None = None) -> DataFrame:
    """Rows younger than the retention: 72 hours for the outbox, 168 for jobs."""
    now = F.current_timestamp() if now is None else now
    return rows.where(F.col(ts).cast("timestamp") >= now - F.make_dt_interval(hours=F.lit(hours)))


def write_daily(submissions: DataFrame, path: str, checkpoint: str, ts: str = "received_at") -> DataStreamWriter:
    """Append feedback to one folder per UTC day."""
    return (
        submissions.withColumn("day", F.to_date(F.col(ts).cast("timestamp")))
        .writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy("day")
    )


def stream_items(submissions: DataFrame) -> DataFrame:
    """Submissions to items, with the checks that need no clock."""
    return feedback.check_items(feedback.explode_items(submissions)).where(F.col("reject_reason").isNull())
