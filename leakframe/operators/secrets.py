"""Unique secrets and set operations between scans.

Whole results stay relational: one row per secret with counts, plus long tables of the files
and commits of each secret.  Lists appear only where a report shows the first few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import masks, names, text
from leakframe.functions.regex import let
from leakframe.operators.ranking import first_n
from leakframe.operators.report import severity_counts
from leakframe.schemas import file_key

ORDER = ["commit_seq", "path", "rule_ord", "match_start"]


def _ord(df: DataFrame, order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order if c in df.columns])


def fold(matches: DataFrame, key: str = "value_hash", order: list[str] | None = None) -> DataFrame:
    """One row per distinct secret: type, severity and name of the first match, first and last
    seen, distinct commits and files.

    One aggregation.  Spark expands the distinct counts and shuffles on (secret, commit or
    file) after a map-side combine, so a secret that is everywhere is spread over tasks.
    """
    order = order or ORDER
    firsts = [c for c in ("value", "exposed_value", "secret_type", "severity", "path", "rule_id",
                          "suggested_variable", "json_section", "json_key") if c in matches.columns and c != key]
    aggs = [
        F.min_by(F.struct(*firsts), _ord(matches, order)).alias("_first"),
        F.count(F.lit(1)).alias("n_matches"),
        F.countDistinct(*file_key(matches)).alias("n_files"),
    ]
    if "commit_hash" in matches.columns:
        aggs.append(F.countDistinct("commit_hash").alias("n_commits"))
    if "commit_ts" in matches.columns:
        aggs += [F.min("commit_ts").alias("first_seen"), F.max("commit_ts").alias("last_seen")]
    keys = _secret_key(matches, key)
    folded = matches.groupBy(*keys).agg(*aggs)
    rest = [c for c in folded.columns if c not in (*keys, "_first")]
    return folded.select(*keys, "_first.*", *rest)


def _secret_key(df: DataFrame, key: str) -> list[str]:
    """A secret is a value inside its repository, where the rows have one."""
    return [c for c in ("repo", key) if c in df.columns]


def places(matches: DataFrame, what: str, key: str = "value_hash", order: list[str] | None = None) -> DataFrame:
    """Long table (secret, file) or (secret, commit) with where it was first seen there."""
    return matches.groupBy(*_secret_key(matches, key), what).agg(F.min(_ord(matches, order or ORDER)).alias("first_ord"))


def first_places(matches: DataFrame, what: str, n: int, key: str = "value_hash", order: list[str] | None = None) -> DataFrame:
    """The first n files or commits of each secret as a list, for reports that show n."""
    keys = _secret_key(matches, key)
    top = first_n(places(matches, what, key, order), keys, ["first_ord", what], n)
    listed = F.array_sort(F.collect_list(F.struct("first_ord", what)))
    return top.groupBy(*keys).agg(F.transform(listed, lambda x: x[what]).alias(f"first_{what}s"))


def name_secrets(secrets: DataFrame, prefix: str = "APP_") -> DataFrame:
    """Environment variable and placeholder of each secret, history form."""
    name = names.history_env_name(F.col("value"), F.col("secret_type"), F.col("path"), prefix)
    return secrets.withColumn("env_var", name).withColumn(
        "replacement", F.concat(F.lit("${"), F.col("env_var"), F.lit("}"))
    )


def locate_in_json(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Add json_section and json_key to matches.

    Texts join to their matches on the file, once per file, not once per match: distinct
    values of a file travel as a list bounded by the file size limit.  The lines of a file are
    folded to their sections once, whatever the number of values.
    """
    on = [c for c in ("repo", "commit_hash", "path") if c in files.columns and c in matches.columns]
    wanted = matches.groupBy(*on).agg(F.collect_set("value").alias("_values"))
    content = F.col("content")

    def located_in(lines: Column) -> Column:
        one = lambda sections: F.transform("_values", lambda v: F.struct(v.alias("value"), text.json_location(content, lines, sections, v).alias("_at")))
        return let(text.json_sections(lines), one)

    located = files.join(wanted, on).select(*on, F.inline(let(F.split(content, "\n", -1), located_in)))
    return matches.join(located.select(*on, "value", "_at.*"), [*on, "value"], "left")


def value_fold(findings: DataFrame) -> DataFrame:
    """Unique secrets by plain value, from findings of one scan."""
    return fold(findings, key="value", order=["path", "line_number", "rule_ord", "match_start"])


def job_dedup(findings: DataFrame) -> DataFrame:
    """Dedup on (value, file) with a count of occurrences."""
    repo = [c for c in ("repo",) if c in findings.columns]
    return findings.groupBy(*repo, masks.job_hash(F.col("value"), F.col("path")).alias("secret_value_hash")).agg(
        F.min("path").alias("path"),
        F.min("line_number").alias("line_number"),
        F.min_by("secret_type", F.struct("line_number", "rule_ord", "match_start")).alias("secret_type"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min(masks.mask(F.col("value"), "task")).alias("value_preview"),
    )


def distinct_values(findings: DataFrame, order: list[str]) -> DataFrame:
    """Distinct values with the place of their first appearance; sort on it for found order."""
    return (
        findings.where(F.col("value") != "")
        .groupBy("value")
        .agg(F.min(_ord(findings, order)).alias("first_ord"))
    )


def per_file(secrets: DataFrame, secret_files: DataFrame, key: str = "value_hash") -> DataFrame:
    """Unique secrets back to one row per file; the first file comes first."""
    keys = _secret_key(secret_files, key)
    return secrets.drop("path").join(secret_files.select(*keys, "path", "first_ord"), keys)


def deleted_files(findings: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files with findings that are not in the current tree, with their finding count."""
    on = [c for c in ("repo", "path") if c in tracked.columns and c in findings.columns]
    counted = findings.groupBy(*on).agg(F.count(F.lit(1)).alias("n_findings"))
    return counted.join(tracked.select(*on).distinct(), on, "left_anti")


_ANCHOR = 8


def drop_covered_partials(secrets: DataFrame) -> DataFrame:
    """Drop partial-type secrets whose value is a proper substring of a full connection string.

    No pair of a partial and a full value is built.  A partial of length n can only equal a
    window of length n of a full string, so candidate windows join on equality.  Windows are
    tried only where the first characters (the anchor) start some partial of that length: a
    hot anchor costs one window per distinct length, whatever number of partials share it.
    """
    partial = F.col("secret_type").isin(fv.PARTIAL_VALUE_TYPES)
    parts = secrets.where(partial & (F.col("value") != "")).select("value").distinct()
    spots = (
        secrets.where(F.col("secret_type").isin(fv.FULL_VALUE_TYPES))
        .select(F.col("value").alias("full"))
        .distinct()
        .select("full", F.explode(F.sequence(F.lit(1), F.greatest(F.length("full"), F.lit(1)))).alias("at"))
    )
    anchors = parts.where(F.length("value") >= _ANCHOR).select(
        F.substring("value", 1, _ANCHOR).alias("anchor"), F.length("value").alias("n")
    ).distinct()
    long = spots.withColumn("anchor", F.substring("full", F.col("at"), F.lit(_ANCHOR))).join(anchors, "anchor")
    # at most _ANCHOR - 1 rows
    lengths = parts.where(F.length("value") < _ANCHOR).select(F.length("value").alias("n")).distinct()
    short = spots.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(_ANCHOR - 1)))).join(
        F.broadcast(lengths), "n"
    )
    windows = (
        long.select("full", "at", "n")
        .unionByName(short.select("full", "at", "n"))
        .where((F.col("n") < F.length("full")) & (F.col("at") + F.col("n") <= F.length("full") + 1))
        .select(F.substring("full", F.col("at"), F.col("n")).alias("value"))
        .distinct()
    )
    covered = parts.join(windows, "value", "left_semi").withColumn("_covered", F.lit(True))
    marked = secrets.join(covered, "value", "left")
    return marked.where(~(partial & F.coalesce("_covered", F.lit(False)))).select(*secrets.columns)


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct values of both scans with a status: cleaned, remaining or new.

    One aggregation over both sides instead of three set operations."""
    sides = baseline.select("value", F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        current.select("value", F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    seen = sides.groupBy("value").agg(F.max("b").alias("b"), F.max("c").alias("c"))
    status = (
        F.when(F.col("c") == 0, F.lit("cleaned")).when(F.col("b") == 1, F.lit("remaining")).otherwise(F.lit("new"))
    )
    return seen.select("value", status.alias("status"))


def compare_summary(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: totals, unique cleaned, remaining and new values, cleanup percent."""
    sides = baseline.select("value", F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        current.select("value", F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    seen = sides.groupBy("value").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    cleaned = F.count_if((F.col("b") > 0) & (F.col("c") == 0))
    base = F.count_if(F.col("b") > 0)
    return seen.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("baseline_total"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("current_total"),
        cleaned.alias("unique_cleaned"),
        F.count_if((F.col("b") > 0) & (F.col("c") > 0)).alias("unique_remaining"),
        F.count_if(F.col("b") == 0).alias("new_findings"),
        F.coalesce(F.try_divide(cleaned * 100.0, base), F.lit(0.0)).alias("cleanup_percentage"),
    )


def severity_change(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Before, after, change and percent change per severity."""
    before = severity_counts(baseline).withColumnRenamed("n", "before")
    after = severity_counts(current).withColumnRenamed("n", "after")
    change = F.col("before") - F.col("after")
    percent = F.when(F.col("before") > 0, F.round(change * 100.0 / F.col("before"))).otherwise(F.lit(0.0))
    return before.join(after, "severity").select(
        "severity", "before", "after", change.alias("change"), percent.alias("percent")
    )


def verify_clean(rescan: DataFrame, purged: DataFrame) -> DataFrame:
    """What a rescan still finds, and whether it was on the purge list.  Empty means clean."""
    marked = purged.select("value").distinct().withColumn("was_purged", F.lit(True))
    return rescan.join(marked, "value", "left").withColumn(
        "was_purged", F.coalesce("was_purged", F.lit(False))
    )


def append_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Findings of the current tree and of history as one table."""
    return current.unionByName(history, allowMissingColumns=True)
