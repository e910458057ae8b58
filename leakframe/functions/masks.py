"""Masks, fingerprints and value shapes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions.regex import let
from leakframe.functions.text import first_hit, sha256

STYLES = ("keep_length", "report", "summary", "job", "task", "wide", "short")


def _left(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def _right(value: Column, n: int) -> Column:
    """Last n characters, the whole value if it is shorter."""
    return F.substring(value, F.greatest(F.lit(1), F.length(value) - n + 1), F.lit(n))


def _ends(value: Column, head: int, middle: str, tail: int) -> Column:
    return F.concat(_left(value, head), F.lit(middle), _right(value, tail))


def _stars(value: Column, keep: int) -> Column:
    n = F.greatest(F.lit(0), F.length(value) - 2 * keep)
    return F.concat(_left(value, keep), F.repeat(F.lit("*"), n), _right(value, keep))


def mask(value: Column, style: str = "keep_length") -> Column:
    """Hide the middle of a secret.  ``style`` names where the reference shows it."""
    n = F.length(value)
    if style == "keep_length":
        return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(_stars(value, 4))
    if style == "report":
        return (
            F.when(value.isNull() | (value == ""), F.lit("****"))
            .when(n <= 8, F.concat(_left(value, 2), F.lit("****")))
            .otherwise(_ends(value, 8, "...", 4))
        )
    if style == "summary":
        return F.when(n <= 16, F.concat(_left(value, 4), F.lit("****"))).otherwise(
            _ends(value, 8, "...", 4)
        )
    if style == "job":
        return F.when(n <= 9, F.lit("***")).otherwise(_ends(value, 3, "...", 3))
    if style == "task":
        return F.when(n > 10, _ends(value, 3, "...", 3)).otherwise(F.lit("***"))
    if style == "wide":
        return (
            F.when(n > 40, _ends(value, 10, "...", 10))
            .when(n > 10, _stars(value, 5))
            .otherwise(F.lit("***"))
        )
    if style == "short":
        return F.when(n > 10, _ends(value, 4, "****", 4)).otherwise(F.lit("****"))
    raise ValueError(f"unknown mask style {style!r}, use one of {STYLES}")


def value_hash(value: Column, profile: str = "full") -> Column:
    """SHA-256 hex of a value; the fast profile keeps 16 characters."""
    digest = sha256(value)
    return F.substring(digest, 1, 16) if profile == "fast" else digest


def fingerprint(path: Column, line_number: Column, matched: Column) -> Column:
    """Stable id of a finding: 32 hex characters over ``path:line:match``."""
    return F.substring(
        sha256(F.concat(path, F.lit(":"), line_number.cast("string"), F.lit(":"), matched)), 1, 32
    )


def job_hash(value: Column, path: Column) -> Column:
    """Dedup key of a secret inside a job."""
    return sha256(F.concat(F.coalesce(value, F.lit("")), F.lit(":"), F.coalesce(path, F.lit(""))))


def shape(value: Column) -> Column:
    """Shape of a value that says nothing about its content, such as ``ghp_[alnum:36]``."""
    prefix = F.coalesce(first_hit((value.startswith(p), p) for p in fv.SHAPE_PREFIXES), F.lit(""))
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    return F.concat(prefix, let(rest, _rest_shape))


def _rest_shape(rest: Column) -> Column:
    n = F.length(rest)
    counts = F.struct(
        n.alias("all"),
        (n - F.length(F.regexp_replace(rest, r"\p{L}", ""))).alias("letters"),
        (n - F.length(F.regexp_replace(rest, r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]", ""))).alias("digits"),
    )

    def describe(c: Column) -> Column:
        kind = (
            F.when((c.letters > 0) & (c.digits > 0), "alnum")
            .when(c.letters > 0, "alpha")
            .when(c.digits > 0, "digit")
            .otherwise("mixed")
        )
        special = c["all"] - c.letters - c.digits
        tail = F.when(special > 0, F.format_string("+[special:%d]", special)).otherwise("")
        return F.when(c["all"] > 0, F.concat(F.format_string("[%s:%d]", kind, c["all"]), tail)).otherwise("")

    return let(counts, describe)
