"""Declared schemas.  JSON inputs are read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakframe import fixed_values as fv

# DDL, so that they can be declared before a session exists

FILES = ("repo string, path string, content string, size_bytes bigint")
BLOBS = (
    "repo string, branch string, commit_hash string, commit_seq bigint, commit_ts timestamp, "
    "path string, content binary"
)
OBJECTS = ("repo string, sha string, path string, type string, size_bytes bigint")
CHANGES = ("repo string, path string, change_type string, content string")
RULES = (
    "rule_id string, name string, regex string, secret_type string, severity string, "
    "description string, remediation string, ord int"
)
FINDINGS = (
    "finding_id string, scan_id string, repo string, branch string, commit_hash string, "
    "commit_ts timestamp, path string, line_number int, column_start int, column_end int, "
    "rule_id string, secret_type string, severity string, exposed_value string, "
    "actual_value string, variable_name string, value_hash string, entropy double, "
    "suggested_variable string, context string, description string, remediation string, "
    "false_positive boolean, fp_reason string, detector string"
)
SECRETS = (
    "value_hash string, value string, secret_type string, severity string, env_var string, "
    "first_seen timestamp, last_seen timestamp, n_commits bigint, n_files bigint"
)
OWN_REPORT = (
    "scan_date string, scanned_path string, total_findings int, findings array<struct<"
    "id:int,type:string,severity:string,file_path:string,line_number:int,column_start:int,"
    "column_end:int,variable_name:string,actual_value:string,full_match:string,"
    "suggested_env_var:string,description:string,remediation:string,context:string>>"
)
GITLEAKS_REPORT = (
    "Description string, StartLine int, EndLine int, StartColumn int, EndColumn int, "
    "`Match` string, Secret string, `File` string, SymlinkFile string, `Commit` string, "
    "Entropy double, Author string, Email string, `Date` string, Message string, "
    "Tags array<string>, RuleID string, Fingerprint string"
)
_ITEM = (
    "array<struct<value_hash:string,secret_type:string,severity:string,value_length:int,"
    "value_pattern:string,file_extension:string,file_type:string>>"
)
FEEDBACK_SUBMISSION = (
    f"timestamp string, version string, client_id string, confirmed_secrets {_ITEM}, "
    f"false_positives {_ITEM}, summary struct<total_detected:int,confirmed_secrets:int,"
    "false_positives:int,false_positive_rate:double>, received_at timestamp, client_ip_hash string"
)
FEEDBACK_ITEMS = (
    "submission_id string, value_hash string, secret_type string, severity string, "
    "value_length int, value_pattern string, file_extension string, file_type string, "
    "is_true_positive boolean"
)
KNOWN_FP = ("pattern string, confidence double, reason string")
SECRETS_EXPORT = (
    "repository string, exported_at string, total_secrets int, secrets array<struct<"
    "env_var:string,value:string,type:string,severity:string,files:array<string>,"
    "commits:array<string>,commit_count:int>>"
)
OUTBOX = (
    "id string, event_id string, event_type string, aggregate_id string, payload string, "
    "published boolean, published_at timestamp, retry_count int, created_at timestamp"
)
REPOS = ("name string, full_name string, url string, branch string")


def severity_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, fv.SEVERITY_RANK.get(s, 0), fv.SEVERITY_SCORE[s]) for s in fv.SEVERITIES]
    return spark.createDataFrame(rows, "severity string, rank int, score int")


def transition_dim(spark: SparkSession) -> DataFrame:
    """All allowed status steps; failing and cancelling are allowed from every live state."""
    live = [s for s in fv.JOB_TRANSITIONS if s not in fv.TERMINAL_STATES]
    steps = [(a, b) for a, targets in fv.JOB_TRANSITIONS.items() for b in targets]
    steps += [(a, b) for a in live for b in ("failed", "cancelled")]
    return spark.createDataFrame(steps, "from_status string, to_status string")


def known_fp_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.DEFAULT_KNOWN_FP, KNOWN_FP)


def file_key(df) -> list[str]:
    """What names a file: its path, inside its repository where the rows have one."""
    return [c for c in ("repo", "path") if c in df.columns]
