"""Job, audit and outbox tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.operators.report import page
from leakframe.schemas import transition_dim


def job_secrets(secrets: DataFrame, jobs: DataFrame, user_id: str | None = None, with_false_positives: bool = False) -> DataFrame:
    """Secrets of jobs, of one owner if given; false positives are left out by default."""
    owned = jobs.where(F.col("user_id") == user_id) if user_id is not None else jobs
    kept = secrets if with_false_positives else secrets.where(~F.col("is_false_positive"))
    return kept.join(owned.select(F.col("id").alias("job_id"), "user_id"), "job_id")


def job_audit(audit: DataFrame, jobs: DataFrame) -> DataFrame:
    """Audit rows with the owner of their job."""
    owners = jobs.select(F.col("id").alias("job_id"), F.col("user_id").alias("owner_id"))
    return audit.join(owners, "job_id").withColumn("by_owner", F.col("user_id") == F.col("owner_id"))


def jobs_of_user(jobs: DataFrame, user_id, status: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    mine = jobs.where(F.col("user_id") == user_id)
    if status:
        mine = mine.where(F.col("status") == status)
    return page(mine, [F.desc("created_at"), F.desc("id")], limit, skip)


def audit_page(audit: DataFrame, by: str, key, skip: int = 0, limit: int = 50) -> DataFrame:
    """Audit rows of a job (by='job_id') or a user (by='user_id'), newest first."""
    return page(audit.where(F.col(by) == key), [F.desc("created_at"), F.desc("id")], limit, skip)


def scans_page(scans: DataFrame, status: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    found = scans.where(F.col("status") == status) if status else scans
    return page(found, [F.desc("created_at"), F.desc("id")], limit, skip)


def user_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("completed_jobs"),
        F.coalesce(F.sum("total_secrets_found"), F.lit(0)).alias("total_secrets_found"),
        F.coalesce(F.sum("secrets_selected_for_cleaning"), F.lit(0)).alias("total_secrets_cleaned"),
    )


def apply_selection(secrets: DataFrame, selections: DataFrame) -> DataFrame:
    """Reset, select and mark secrets of the jobs that were decided on.

    ``selections`` has job_id, secret_id and action ('select' or 'false_positive'); a false
    positive wins over a selection.  Secrets of other jobs keep their flags.
    """
    acted = selections.groupBy("job_id", F.col("secret_id").alias("id")).agg(
        F.bool_or(F.col("action") == "select").alias("_pick"),
        F.bool_or(F.col("action") == "false_positive").alias("_fp"),
    )
    decided = selections.select("job_id").distinct().withColumn("_decided", F.lit(True))
    joined = secrets.join(decided, "job_id", "left").join(acted, ["job_id", "id"], "left")
    fp, pick = F.coalesce("_fp", F.lit(False)), F.coalesce("_pick", F.lit(False))
    was = F.col("selected_for_cleaning") & F.col("_decided").isNull()
    return (
        joined.withColumn("selected_for_cleaning", was | (pick & ~fp))
        .withColumn("is_false_positive", F.col("is_false_positive") | fp)
        .select(*secrets.columns)
    )


def check_transitions(history: DataFrame) -> DataFrame:
    """Each status change with the status before it and whether the step is allowed.

    ``history`` has job_id, seq, status.  A job has a bounded number of steps, so the window
    groups are small.  The step table is fixed.
    """
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    steps = transition_dim(history.sparkSession).withColumn("_allowed", F.lit(True))
    chained = history.withColumn("from_status", before).withColumnRenamed("status", "to_status")
    return chained.join(F.broadcast(steps), ["from_status", "to_status"], "left").withColumn(
        "valid", F.col("from_status").isNull() | F.coalesce("_allowed", F.lit(False))
    ).drop("_allowed")


def state_flags(status: Column) -> tuple[Column, Column]:
    """(is_terminal, is_active) of a job status."""
    return status.isin(fv.TERMINAL_STATES), status.isin(fv.ACTIVE_STATES)


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("expires_at") < now) & ~F.col("status").isin(fv.EXPIRY_EXEMPT_STATES))


def outbox_batch(outbox: DataFrame, size: int = 100) -> DataFrame:
    """Oldest unpublished events."""
    return page(outbox.where(~F.col("published")), ["created_at", "id"], size)


def outbox_split(outbox: DataFrame, now: Column, max_retries: int = 5, retention_hours: int = 72) -> DataFrame:
    """Route of each event: publish, dead_letter, purge (published and old) or keep."""
    old = F.col("published_at") < now - F.make_dt_interval(hours=F.lit(retention_hours))
    route = (
        F.when(F.col("published") & F.coalesce(old, F.lit(False)), F.lit("purge"))
        .when(F.col("published"), F.lit("keep"))
        .when(F.col("retry_count") >= max_retries, F.lit("dead_letter"))
        .otherwise(F.lit("publish"))
    )
    return outbox.withColumn("route", route)


def after_publish(outbox: DataFrame, delivered: DataFrame, now: Column, max_retries: int = 5) -> DataFrame:
    """The outbox after an attempt on every waiting event below the retry limit.

    Events in ``delivered`` (column ``id``) are marked published; the other attempts count."""
    done = delivered.select("id").distinct().withColumn("_done", F.lit(True))
    tried = ~F.col("published") & (F.col("retry_count") < max_retries)
    sent = tried & F.coalesce("_done", F.lit(False))
    changed = outbox.join(done, "id", "left").select(
        *[F.col(c) for c in outbox.columns if c not in ("published", "published_at", "retry_count")],
        (F.col("published") | sent).alias("published"),
        F.when(sent, now).otherwise(F.col("published_at")).alias("published_at"),
        F.when(tried & ~sent, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
    )
    return changed.select(*outbox.columns)


def audit_rows(actions: DataFrame) -> DataFrame:
    """Audit rows of actions, in the shape that is appended to ``audit_logs``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("job_id", "user_id", "action", "created_at")]
    return actions.select(
        F.sha2(F.concat_ws(":", *parts), 256).alias("id"), "job_id", "user_id", "action",
        F.to_json(F.struct("details")).alias("details"), "created_at",
    )
