"""Sinks.  Each builds a DataFrame and writes it with Spark, in parallel.

Values are masked unless the caller asks for them.  Ordered text uses a range-partitioned
sort, so the part files in name order are the ordered document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leakframe.functions import classify, masks, names
from leakframe.operators import report, secrets
from leakframe.operators.ranking import first_n
from leakframe.operators.redact import dry_run, purge_line, replacement_table
from leakframe.schemas import file_key

_ORDER = ["path", "line_number", "rule_ord", "match_start"]


def _shown(value: Column, show_values: bool) -> Column:
    return value if show_values else masks.mask(value)


def _id() -> Column:
    return F.col("finding_id")


# ------------------------------------------------------------------ rows
def findings_rows(findings: DataFrame, show_values: bool = False) -> DataFrame:
    return findings.select(
        _id().alias("id"), F.col("secret_type").alias("type"), "severity",
        F.col("path").alias("file_path"), "line_number",
        F.coalesce("variable_name", "suggested_variable").alias("variable_name"),
        _shown(F.col("value"), show_values).alias("actual_value"),
        _shown(F.col("exposed_value"), show_values).alias("full_match"),
        F.col("suggested_variable").alias("suggested_env_var"),
        "description", "remediation",
        (F.col("context") if show_values else F.lit(None).cast("string")).alias("context"),
    )


def csv_rows(findings: DataFrame, show_values: bool = False) -> DataFrame:
    dash = F.lit("-")
    return findings.select(
        _id().alias("ID"), F.col("severity").alias("Severity"), F.col("secret_type").alias("Type"),
        F.coalesce("variable_name", "suggested_variable", dash).alias("Variable Name"),
        _shown(F.col("value"), show_values).alias("Actual Value"),
        F.coalesce("suggested_variable", dash).alias("Suggested Env Var"),
        F.col("path").alias("File"), F.col("line_number").alias("Line"),
        F.col("description").alias("Description"),
    )


def report_csv_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.col("severity").alias("Severity"), F.col("secret_type").alias("Type"),
        F.col("path").alias("File"), F.col("line_number").alias("Line"),
        F.coalesce("variable_name", F.lit("")).alias("Variable"),
        F.col("description").alias("Description"),
    )


def header_row(findings: DataFrame, scanned_path: str, scan_date: Column) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total_findings")).select(
        scan_date.cast("string").alias("scan_date"), F.lit(scanned_path).alias("scanned_path"), "total_findings"
    )


def gitleaks_rows(findings: DataFrame, show_values: bool = False) -> DataFrame:
    empty = F.lit("")
    rule = F.when(F.col("detector") == "rule", F.coalesce("rule_id", "secret_type")).otherwise(F.col("secret_type"))
    return findings.select(
        F.coalesce(F.nullif("description", empty), "secret_type").alias("Description"),
        F.col("line_number").alias("StartLine"), F.col("line_number").alias("EndLine"),
        F.col("column_start").alias("StartColumn"), F.col("column_end").alias("EndColumn"),
        _shown(F.col("exposed_value"), show_values).alias("Match"),
        _shown(F.col("value"), show_values).alias("Secret"),
        F.col("path").alias("File"), empty.alias("SymlinkFile"), empty.alias("Commit"),
        F.when(F.col("detector") == "entropy", F.col("entropy")).otherwise(F.lit(0.0)).alias("Entropy"),
        empty.alias("Author"), empty.alias("Email"), empty.alias("Date"), empty.alias("Message"),
        F.array("severity", "secret_type").alias("Tags"),
        rule.alias("RuleID"),
        masks.fingerprint(F.col("path"), F.col("line_number"), F.col("exposed_value")).alias("Fingerprint"),
    )


def purge_rows(findings: DataFrame, use_env: bool = False) -> DataFrame:
    """Distinct values in found order, one line each."""
    order = F.struct(*_ORDER)
    chosen = findings.where(F.col("value") != "").groupBy("value").agg(
        F.min(order).alias("_ord"), F.min_by("suggested_variable", order).alias("_name")
    )
    named = F.concat(F.col("value"), F.lit("==>${"), F.col("_name"), F.lit("}"))
    line = F.coalesce(named, F.col("value")) if use_env else F.col("value")
    return chosen.orderBy("_ord").select(line.alias("line"))


def purge_file_rows(selected: DataFrame) -> DataFrame:
    """Lines of a selection that has value and replacement."""
    return selected.orderBy("value").select(purge_line(F.col("value"), F.col("replacement")).alias("line"))


def env_template_rows(findings: DataFrame, show_files: int = 3) -> DataFrame:
    """Per variable: type of the first finding and the first files, as one block of text."""
    order = F.struct(*_ORDER)
    name = F.coalesce("variable_name", "suggested_variable")
    named = findings.select(name.alias("name"), "secret_type", *_ORDER).where(F.col("name").isNotNull())
    kinds = named.groupBy("name").agg(F.min_by("secret_type", order).alias("kind"))
    files = named.groupBy("name", "path").agg(F.min(order).alias("_ord"))
    shown = (
        first_n(files, ["name"], ["_ord"], show_files)
        .groupBy("name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "path"))), lambda x: x.path).alias("_files"))
    )
    block = F.concat(
        F.lit("# Type: "), F.col("kind"), F.lit("\n# Found in: "), F.array_join("_files", ", "),
        F.lit("\n"), F.col("name"), F.lit("=your_value_here\n"),
    )
    return kinds.join(shown, "name").orderBy("name").select("name", block.alias("line"))


def env_file_rows(secrets: DataFrame, include_values: bool = True, docker: bool = False) -> DataFrame:
    """Env file entries: sanitised name, clean value, group; the first secret of a name wins.

    Needs env_var, value, secret_type and an ``ord`` column."""
    name = names.sanitize(F.col("env_var"))
    clean = names.clean_value(F.col("value"))
    picked = (
        secrets.where(F.col("value") != "")
        .select(name.alias("name"), clean.alias("value"), "secret_type", "ord")
        .groupBy("name")
        .agg(F.min_by(F.struct("value", "secret_type"), "ord").alias("_s"), F.min("ord").alias("ord"))
        .select("name", "_s.*", "ord")
        .withColumn("category", classify.env_file_group(F.col("secret_type")))
    )
    quoted = F.concat(F.col("name"), F.lit('="'), F.replace("value", F.lit('"'), F.lit('\\"')), F.lit('"'))
    template = F.concat(F.col("name"), F.lit('="<your-'), F.col("secret_type"), F.lit('-here>"'))
    if docker:
        line = F.concat(F.col("name"), F.lit("="), F.col("value"))
        return picked.orderBy("ord").select("category", "name", line.alias("line"))
    rank = F.array_position(
        F.array(*[F.lit(c) for c in ("database", "api_keys", "auth", "cloud", "other")]), F.col("category")
    )
    line = F.concat(F.lit("# Type: "), F.col("secret_type"), F.lit("\n"), quoted if include_values else template)
    return picked.orderBy(rank, "ord").select("category", "name", line.alias("line"))


def ci_rows(secrets: DataFrame) -> DataFrame:
    """CI variable lines sorted by name, one per name."""
    name = names.sanitize(F.col("env_var"))
    line = F.concat(F.lit("  "), F.col("name"), F.lit(": ${{ secrets."), F.col("name"), F.lit(" }}"))
    return (
        secrets.where(F.col("value") != "").select(name.alias("name")).distinct()
        .orderBy("name").select("name", line.alias("line"))
    )


def ci_report_rows(findings: DataFrame, prefix: str = "APP_") -> DataFrame:
    """CI names from findings, first file of a name wins, with their group."""
    have = lambda c: F.col(c) if c in findings.columns else F.lit("")
    name = names.ci_name(have("json_section"), have("json_key"), F.col("secret_type"), F.col("path"))
    order = F.struct(*_ORDER)
    return (
        findings.withColumn("env_var", name)
        .groupBy("env_var")
        .agg(F.min_by(F.struct("path", "secret_type"), order).alias("_f"))
        .select(
            "env_var", F.concat(F.lit(prefix), "env_var").alias("ci_secret"), "_f.*",
            classify.ci_group(F.col("env_var"), F.col("_f.secret_type")).alias("group"),
        )
    )


def mapping_rows(secrets: DataFrame, style: str = "json", show_values: bool = False, prefix: str = "APP_") -> DataFrame:
    """Variable mapping as table rows (json), shell lines (env) or CI lines (ci)."""
    if style == "json":
        kept = [c for c in ("secret_type", "severity", "first_paths", "json_section", "json_key") if c in secrets.columns]
        return secrets.select("env_var", _shown(F.col("value"), show_values).alias("value"), *kept)
    if style == "env":
        quote = F.replace(_shown(F.col("value"), show_values), F.lit("'"), F.lit("'\\''"))
        line = F.concat(
            F.lit("# Type: "), "secret_type", F.lit(", Severity: "), "severity", F.lit("\n"),
            "env_var", F.lit("='"), quote, F.lit("'\n"),
        )
        return secrets.select("env_var", line.alias("line"))
    if style == "ci":
        bare = F.replace("env_var", F.lit(prefix), F.lit(""))
        line = F.concat(F.lit("        "), bare, F.lit(": ${{ secrets."), F.col("env_var"), F.lit(" }}"))
        return secrets.select("env_var", line.alias("line"))
    raise ValueError(f"unknown style {style!r}")


def cleanup_rows(secrets: DataFrame) -> DataFrame:
    """Cleaned secrets: type, severity, preview, numbers of files and commits, replacement."""
    preview = F.when(F.length("value") > 20, F.concat(F.substring("value", 1, 20), F.lit("..."))).otherwise(F.col("value"))
    return secrets.select(
        F.col("secret_type").alias("type"), "severity", "env_var", preview.alias("value_preview"),
        "n_files", "n_commits", F.coalesce("replacement", F.lit("***REMOVED***")).alias("replacement"),
    )


def cleanup_tables(matches: DataFrame, large: DataFrame) -> dict[str, DataFrame]:
    """The cleanup report of a history scan as tables: secrets, the files and commits of each
    (keyed by repository and value hash), large files and the counters."""
    found = secrets.name_secrets(secrets.fold(matches))
    files, commits = secrets.places(matches, "path"), secrets.places(matches, "commit_hash")
    return {
        "secrets": cleanup_rows(found), "files": files.drop("first_ord"), "commits": commits.drop("first_ord"),
        "large_files": large, "counters": dry_run(found, large),
    }


def audit_tables(findings: DataFrame) -> dict[str, DataFrame]:
    """The tables of the audit reports over one scan."""
    return {
        "severities": report.severity_counts(findings), "types": report.type_counts(findings), "files": by_file_rows(findings),
        "categories": report.category_table(findings), "lines": report.lines_per_file(findings), "extensions": report.extension_counts(findings),
        "technologies": classify.technologies_in_findings(findings), "replacements": replacement_table(findings),
    }


def write_audit(findings: DataFrame, path: str) -> dict:
    """The audit tables as JSON below ``path/tab=...`` and the numbers of the header, which are
    observed while the rows are written."""
    seen = Observation("audit")
    of = lambda name, when: F.coalesce(F.sum(F.when((F.col("tab") == "severities") & when, F.col("n"))), F.lit(0)).alias(name)
    rows = report.audit_rows(findings).observe(
        seen, of("findings", F.lit(True)), of("critical", F.col("name") == "critical"),
        F.count_if(F.col("tab") == "files").alias("files"), F.count_if(F.col("tab") == "types").alias("types"),
    )
    rows.write.partitionBy("tab").json(path)
    return seen.get


def by_file_rows(findings: DataFrame) -> DataFrame:
    """Findings grouped by file for a view: counts per severity and file."""
    return findings.groupBy(*file_key(findings)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
    )


# ------------------------------------------------------------------ writers
def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("line").write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows, one folder per day."""
    write_parquet(rows.withColumn("day", F.to_date("created_at")), path, ["day"])
