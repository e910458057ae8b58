"""Readers.  Every JSON input has a declared schema; file listings and filters are Spark's."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe import schemas
from leakframe.functions import text
from leakframe.operators import rules as rule_ops
from leakframe.operators.paths import keep_scannable
from leakframe.operators.rules import Rule, ScanConfig


def decode_text(raw: Column) -> Column:
    """UTF-8 text, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def decode_lossy(raw: Column) -> Column:
    """UTF-8 text with invalid bytes left out."""
    as_text = raw.cast("string")
    # only damaged text takes the detour; a replacement mark that was in the text is a valid
    # character and is told from repaired bytes by the check before
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.replace(F.make_valid_utf8(as_text), F.lit("�"), F.lit(""))
    )


def directory(
    spark: SparkSession, root: str, repo: str, config: ScanConfig | None = None, max_files: int | None = None
) -> DataFrame:
    """Files of a directory tree as ``schemas.FILES``.

    The size filter reaches the file source, so large files are not read.  ``max_files`` counts
    files that would be scanned, in path order."""
    config = config or ScanConfig()
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .where(F.col("length") <= config.max_file_size)
    )
    # listed paths have a scheme, and maybe a host, whether or not the root was given with them
    prefix = r"^(?:[A-Za-z][\w+.-]*:(?://[^/]*)?)?/*" + "/".join(_quote(p) for p in urlparse(root).path.split("/") if p) + "/"
    files = raw.select(
        F.lit(repo).alias("repo"),
        F.regexp_replace("path", F.lit(prefix), F.lit("")).alias("path"),
        decode_lossy(F.col("content")).alias("content"),
        F.col("length").alias("size_bytes"),
    )
    return keep_scannable(files, config).orderBy("path").limit(max_files) if max_files else files


def _quote(part: str) -> str:
    return r"\Q" + part + r"\E"


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


SPREAD_ROWS = 20_000  # rows of a task at most, where rows are few bytes but much work


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread a small scan over all cores before CPU-bound text work.

    Only for a plain scan with fewer splits than cores (then its text is at most a few
    splits).  A large table has more splits than cores and is left as it is, unshuffled.
    With ``rows`` the scan is narrow and a text is built from each row afterwards: splits go by
    bytes and say nothing about the work, so tasks are dealt that many rows each, at any size.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming:
        return scan
    if rows is not None:
        return scan.repartition(max(cores, -(-scan.count() // rows)))
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def history(blobs: DataFrame, branch: str | None = None) -> DataFrame:
    """Revision blobs with their text decoded; filter on branch before the text is touched."""
    kept = blobs.where(F.col("branch") == branch) if branch else blobs
    return kept.withColumn("content", decode_text(F.col("content")))


def staged_changes(changes: DataFrame) -> DataFrame:
    """Added, copied, modified and renamed files."""
    return changes.where(F.col("change_type").isin("A", "C", "M", "R"))


def _rule_rows(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(schemas.RULES)
    return reader.parquet(path) if path.endswith(".parquet") else reader.json(path)


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines or Parquet, each with the ``problem`` that a scan would have with it."""
    return rule_ops.checked(_rule_rows(spark, path).fillna("", ["description", "remediation"]))


def rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rule catalog for a scan: validated, on the driver."""
    return rule_ops.from_table(_rule_rows(spark, path))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of an earlier scan: our report object or a gitleaks-style list.

    The two forms share no required field, so each row is read with both schemas.
    """
    both = spark.read.option("multiLine", True)
    own = both.schema(schemas.OWN_REPORT).json(path).select(F.explode("findings").alias("f"))
    own = own.select(
        F.coalesce("f.type", F.lit("generic_secret")).alias("secret_type"),
        F.coalesce("f.severity", F.lit("medium")).alias("severity"),
        F.coalesce("f.file_path", F.lit("")).alias("path"),
        F.coalesce("f.line_number", F.lit(0)).alias("line_number"),
        F.coalesce("f.column_start", F.lit(0)).alias("column_start"),
        F.coalesce("f.column_end", F.lit(0)).alias("column_end"),
        F.coalesce("f.full_match", F.lit("")).alias("exposed_value"),
        F.coalesce("f.actual_value", F.lit("")).alias("actual_value"),
    )
    leaks = both.schema(schemas.GITLEAKS_REPORT).json(path).where(
        F.coalesce("RuleID", "Match", "File").isNotNull()
    )
    leaks = leaks.select(
        F.coalesce("RuleID", F.lit("generic_secret")).alias("secret_type"),
        F.coalesce(F.get("Tags", F.lit(0)), F.lit("medium")).alias("severity"),
        F.coalesce("File", F.lit("")).alias("path"),
        F.coalesce("StartLine", F.lit(0)).alias("line_number"),
        F.coalesce("StartColumn", F.lit(0)).alias("column_start"),
        F.coalesce("EndColumn", F.lit(0)).alias("column_end"),
        F.coalesce("Match", F.lit("")).alias("exposed_value"),
        F.coalesce("Secret", F.lit("")).alias("actual_value"),
    )
    value = F.coalesce(F.nullif("actual_value", F.lit("")), "exposed_value")
    return own.unionByName(leaks).withColumn("value", value)


def purge_list(spark: SparkSession, path: str) -> DataFrame:
    """``value==>replacement`` lines as secrets of unknown type."""
    line = text.python_strip(F.col("value"))
    lines = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", r"\Q==>\E", 2)
    return lines.select(
        F.get(parts, F.lit(0)).alias("value"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit(fv.REMOVED)).alias("replacement"),
        F.substring(text.sha256(F.get(parts, F.lit(0))), 1, 16).alias("value_hash"),
        F.lit("unknown").alias("secret_type"),
        F.lit("high").alias("severity"),
    )


def feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Feedback submissions, one JSON object per line, in batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.FEEDBACK_SUBMISSION).json(path)


def findings_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a report written by ``sinks.findings_json``."""
    return spark.read.schema(
        "id bigint, type string, severity string, file_path string, line_number int, "
        "variable_name string, actual_value string, full_match string, suggested_env_var string, "
        "description string, remediation string, context string"
    ).json(path)


def repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories to process as one batch; ``repo`` is a grouping key in every operator."""
    return spark.read.schema(schemas.REPOS).json(path)


def exported_secrets(spark: SparkSession, path: str) -> DataFrame:
    """Secrets of an earlier export; the hash comes from the value again."""
    raw = spark.read.option("multiLine", True).schema(schemas.SECRETS_EXPORT).json(path)
    return raw.select(F.explode("secrets").alias("s")).select(
        F.substring(text.sha256(F.col("s.value")), 1, 16).alias("value_hash"),
        F.col("s.value").alias("value"),
        F.coalesce("s.type", F.lit("unknown")).alias("secret_type"),
        F.coalesce("s.severity", F.lit("high")).alias("severity"),
        F.coalesce("s.files", F.array().cast("array<string>")).alias("files"),
        F.coalesce("s.commits", F.array().cast("array<string>")).alias("commits"),
        F.col("s.env_var").alias("env_var"),
    )
