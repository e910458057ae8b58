"""Verification as data: format checks and probe responses collected elsewhere.  No calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import text
from leakframe.functions.regex import hits


def verifier_of(secret_type: Column) -> Column:
    """Verifier for a type, NULL for an unsupported one."""
    return text.lookup(secret_type, fv.VERIFIER_BY_TYPE)


def format_status(secret_type: Column, value: Column) -> Column:
    """STRUCT(status, message) from the format alone.

    NULL status is never returned: types that need a live call stay ``unverified``."""
    verifier = verifier_of(secret_type)

    def verdict(status: str, message: Column | str) -> Column:
        message = F.lit(message) if isinstance(message, str) else message
        return F.struct(F.lit(status).alias("status"), message.alias("message"))

    pairs = [
        (secret_type.isNull() | value.isNull(), verdict("error", "Missing secret type or value")),
        (
            verifier.isNull(),
            verdict("unverified", F.concat(F.lit("No verifier available for type: "), secret_type)),
        ),
    ]
    for name, (pattern, good, bad_status, bad) in fv.FORMAT_CHECKS.items():
        fits = hits(value, pattern, ignore_case=False)
        pairs.append(((verifier == name) & fits, verdict("unverified", good)))
        pairs.append((verifier == name, verdict(bad_status, bad)))
    pairs += [(verifier == name, verdict("unverified", msg)) for name, msg in fv.PAIRED_CHECKS.items()]
    return text.first_hit(pairs + [(F.lit(True), verdict("unverified", "Needs a probe response"))])


def probe_status(http_status: Column, body: Column) -> Column:
    """Status from an HTTP response of a provider."""
    limited = F.lower(F.coalesce(body, F.lit(""))).contains("rate limit")
    return (
        F.when(http_status == 200, F.lit("verified_active"))
        .when(http_status == 401, F.lit("verified_inactive"))
        .when((http_status == 403) & limited, F.lit("rate_limited"))
        .when(http_status == 403, F.lit("verified_active"))
        .otherwise(F.lit("error"))
    )


def outcome(status: Column) -> Column:
    """Three-way answer: active, inactive, unknown."""
    return (
        F.when(status == "verified_active", F.lit("active"))
        .when(status == "verified_inactive", F.lit("inactive"))
        .otherwise(F.lit("unknown"))
    )


def verify(findings: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """One verification row per finding; a probe response beats the format check, except for
    types that are only checked by format."""
    value = F.col("value")
    base = findings.select(
        "finding_id", verifier_of(F.col("secret_type")).alias("verifier"),
        format_status(F.col("secret_type"), value).alias("_f"),
    ).select("finding_id", "verifier", "_f.status", "_f.message")
    if probes is None:
        return base.withColumn("outcome", outcome(F.col("status")))
    probed = base.join(probes.select("finding_id", "http_status", "body"), "finding_id", "left")
    by_format = F.col("verifier").isNull() | F.col("verifier").isin(
        list(fv.FORMAT_CHECKS) + list(fv.PAIRED_CHECKS)
    )
    live = ~by_format & F.col("http_status").isNotNull()
    status = F.when(live, probe_status(F.col("http_status"), F.col("body"))).otherwise(F.col("status"))
    return (
        probed.withColumn("status", status)
        .withColumn("outcome", outcome(F.col("status")))
        .drop("http_status", "body")
    )
