"""Aggregations behind reports, filters on findings, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import classify, text
from leakframe.operators.ranking import first_n
from leakframe.schemas import file_key, severity_dim
from leakframe.session import cut_lineage

LEVELS = fv.SEVERITIES[:4]


def _severity_ifs(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s}") for s in LEVELS]


# ------------------------------------------------------------------ counts
def severity_counts(findings: DataFrame) -> DataFrame:
    """One row per severity, zeros included."""
    levels = severity_dim(findings.sparkSession).where(F.col("severity").isin(LEVELS)).select("severity")
    counted = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def result_counts(judged: DataFrame) -> DataFrame:
    """One row: five severities and the total, false positives left out."""
    real = ~F.col("false_positive")
    ifs = [F.count_if(real & (F.col("severity") == s)).alias(s) for s in fv.SEVERITIES]
    return judged.agg(*ifs, F.count_if(real).alias("total"))


def type_counts(findings: DataFrame, n: int | None = None) -> DataFrame:
    counted = findings.groupBy("secret_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "secret_type").limit(n) if n else counted


def file_counts(findings: DataFrame, n: int = 10) -> DataFrame:
    """Files with most findings, with the split by severity."""
    key = file_key(findings)
    counted = findings.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *_severity_ifs())
    return counted.orderBy(F.desc("n"), *key).limit(n)


def category_table(findings: DataFrame) -> DataFrame:
    """Findings, critical and high per category, with a priority; sort by critical."""
    return (
        findings.groupBy(classify.type_category(F.col("secret_type")).alias("category"))
        .agg(F.count(F.lit(1)).alias("findings"), *_severity_ifs()[:2])
        .withColumn("priority", classify.priority(F.col("critical"), F.col("high")))
    )


AUDIT = "tab, name, repo, path, n, critical, high, medium, low, priority, distinct_lines, lines"


def audit_rows(findings: DataFrame) -> DataFrame:
    """The tables of the audit report as one set of rows (columns of ``AUDIT``): counts by severity
    with zeros, by type, by file, by category with its priority, and by category and file.

    Findings are counted once, into a narrow stored table of distinct places; the five tables are
    grouping sets over it, told apart by their grouping id."""
    category = classify.type_category(F.col("secret_type")).alias("category")
    key = file_key(findings)
    places = ["severity", "secret_type", "category", *key, "line_number"]
    counted = cut_lineage(findings.select("severity", "secret_type", category, *key, "line_number").groupBy(*places).agg(F.count(F.lit(1)).alias("n")))
    flat = counted.withColumn("level", F.col("severity")).withColumn("line", F.when(F.col("line_number") > 0, F.col("line_number")))
    own = ["severity", "secret_type", "category", *key]
    sets = {"severities": ["severity"], "types": ["secret_type"], "files": key, "categories": ["category"], "lines": ["category", *key]}
    levels = [F.sum(F.when(F.col("level") == s, F.col("n")).otherwise(0)).alias(s) for s in LEVELS]
    rows = flat.groupingSets(list(sets.values()), *own).agg(
        F.grouping_id().alias("_id"), F.sum("n").alias("n"), *levels, F.count_distinct("line").alias("distinct_lines")
    )
    number = {tab: sum(1 << (len(own) - 1 - i) for i, c in enumerate(own) if c not in cols) for tab, cols in sets.items()}
    tab = F.create_map(*[F.lit(x) for t, i in number.items() for x in (i, t)])[F.col("_id").cast("int")]
    rows = rows.withColumn("tab", tab).withColumn("priority", classify.priority(F.col("critical"), F.col("high")))
    only = lambda column, *tabs: F.when(F.col("tab").isin(*tabs), F.col(column))
    shown = rows.select(
        "tab", F.coalesce(only("severity", "severities"), only("secret_type", "types"), only("category", "categories", "lines")).alias("name"),
        *key, "n", *[only(s, "files", *(["categories"] if s in LEVELS[:2] else [])).alias(s) for s in LEVELS],
        only("priority", "categories").alias("priority"), only("distinct_lines", "lines").alias("distinct_lines"),
    ).where(~((F.col("tab") == "severities") & ~F.coalesce(F.col("name").isin(LEVELS), F.lit(False))))
    # the first lines of each category and file, from the same stored places
    per_line = counted.groupBy("category", *key, "line_number").agg(F.lit(1).alias("one"))
    first = first_n(per_line.where("line_number > 0"), ["category", *key], ["line_number"], 10).groupBy("category", *key).agg(
        F.array_join(F.sort_array(F.collect_list("line_number")), ", ").alias("lines")
    )
    same = [F.lit("lines") == shown.tab, shown.name.eqNullSafe(first.category), *[shown[c].eqNullSafe(first[c]) for c in key]]
    full = shown.join(first, same, "left").select(*[shown[c] for c in shown.columns], F.when(shown.tab == "lines", F.coalesce("lines", F.lit(""))).alias("lines"))
    zeros = severity_dim(findings.sparkSession).where(F.col("severity").isin(LEVELS)).select(F.lit("severities").alias("tab"), F.col("severity").alias("name"), F.lit(0).cast("bigint").alias("n"))
    zeros = zeros.join(full.select("tab", "name"), ["tab", "name"], "left_anti")
    full = full.unionByName(zeros, allowMissingColumns=True)
    return full.select(*[F.col(c) if c in full.columns else F.lit(None).cast("string").alias(c) for c in AUDIT.split(", ")])


def content_categories(findings: DataFrame) -> DataFrame:
    """Findings per content category."""
    category = classify.finding_category(F.col("secret_type"), F.col("context"), F.col("exposed_value"))
    return findings.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("findings"))


def lines_per_file(findings: DataFrame, n: int = 10) -> DataFrame:
    """Per category and file: finding count, distinct lines and the first n line numbers.

    Line numbers are deduplicated and cut to n by a window that limits groups before the
    shuffle, so a file with any number of lines stays small.
    """
    category = classify.type_category(F.col("secret_type")).alias("category")
    keys = ["category", *file_key(findings)]
    per_line = findings.select(category, *file_key(findings), "line_number").groupBy(*keys, "line_number").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = per_line.groupBy(*keys).agg(
        F.sum("n").alias("findings"), F.count_if(F.col("line_number") > 0).alias("distinct_lines")
    )
    shown = (
        first_n(per_line.where(F.col("line_number") > 0), keys, ["line_number"], n)
        .groupBy(*keys)
        .agg(F.array_join(F.sort_array(F.collect_list("line_number")), ", ").alias("lines"))
    )
    return totals.join(shown, keys, "left")


def preclean_totals(matches: DataFrame) -> DataFrame:
    """One row: distinct secrets, files and commits."""
    return matches.agg(
        F.countDistinct("value_hash").alias("secrets"),
        F.countDistinct(*file_key(matches)).alias("files"),
        F.countDistinct("commit_hash").alias("commits"),
    )


def preclean_by_type(matches: DataFrame) -> DataFrame:
    """Per type: distinct secrets, files and commits, straight from the matches."""
    return matches.groupBy("secret_type").agg(
        F.countDistinct("value_hash").alias("secrets"),
        F.countDistinct(*file_key(matches)).alias("files"),
        F.countDistinct("commit_hash").alias("commits"),
    )


def preclean_top_files(matches: DataFrame, n: int = 20) -> DataFrame:
    """Files with most distinct secrets, with their types.

    Types per file are few (at most the catalog), so their set is bounded."""
    key = file_key(matches)
    return (
        matches.groupBy(*key)
        .agg(
            F.countDistinct("value_hash").alias("secrets"),
            F.array_join(F.sort_array(F.collect_set("secret_type")), ", ").alias("types"),
        )
        .orderBy(F.desc("secrets"), *key)
        .limit(n)
    )


def extension_counts(findings: DataFrame, n: int = 5) -> DataFrame:
    ext = F.coalesce(F.nullif(text.suffix(F.col("path")), F.lit("")), F.lit("other"))
    return (
        findings.groupBy(ext.alias("ext"))
        .agg(F.countDistinct(*file_key(findings)).alias("files"))
        .orderBy(F.desc("files"), "ext")
        .limit(n)
    )


def large_objects(objects: DataFrame, limit_bytes: int = fv.LARGE_OBJECT_BYTES) -> DataFrame:
    """Largest size of every path that has a blob above the limit.  A blob without a path is
    known by its sha."""
    return (
        objects.where((F.col("type") == "blob") & (F.col("size_bytes") > limit_bytes))
        .groupBy(F.coalesce("path", "sha").alias("path"))
        .agg(F.max("size_bytes").alias("size_bytes"))
    )


def repo_metrics(blobs: DataFrame) -> DataFrame:
    """Commits, branches, first and last date, years and bytes per repo."""
    first, last = F.to_date(F.min("commit_ts")), F.to_date(F.max("commit_ts"))
    remote = F.col("branch").startswith("remotes/")
    return blobs.groupBy("repo").agg(
        F.countDistinct("commit_hash").alias("total_commits"),
        F.countDistinct("branch").alias("total_branches"),
        F.countDistinct(F.when(~remote, F.col("branch"))).alias("local_branches"),
        F.countDistinct(F.when(remote, F.col("branch"))).alias("remote_branches"),
        first.alias("first_commit_date"),
        last.alias("last_commit_date"),
        (F.datediff(last, first) / 365.25).alias("history_years"),
        F.sum(F.octet_length("content")).alias("size_bytes"),
    )


def rule_summary(catalog: DataFrame) -> DataFrame:
    """Rules by severity and by type, in one pass over two grouping sets."""
    return (
        catalog.groupingSets([["severity"], ["secret_type"]], "severity", "secret_type")
        .agg(F.grouping("severity").alias("_g"), F.count(F.lit(1)).alias("n"))
        .select(
            F.when(F.col("_g") == 0, F.lit("severity")).otherwise(F.lit("type")).alias("dimension"),
            F.when(F.col("_g") == 0, F.col("severity")).otherwise(F.col("secret_type")).alias("name"),
            "n",
        )
    )


def verification_counts(verifications: DataFrame) -> DataFrame:
    """One row: total and the five outcomes."""
    names = {
        "active": "verified_active", "inactive": "verified_inactive", "unverified": "unverified",
        "error": "error", "rate_limited": "rate_limited",
    }
    return verifications.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == v).alias(k) for k, v in names.items()],
    )


def scan_summary(findings: DataFrame, verifications: DataFrame) -> DataFrame:
    """Per severity and type: findings, active and inactive ones."""
    joined = with_verification(findings, verifications)
    return joined.groupBy("severity", "secret_type").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("status") == "verified_active").alias("active"),
        F.count_if(F.col("status") == "verified_inactive").alias("inactive"),
    )


def with_verification(findings: DataFrame, verifications: DataFrame) -> DataFrame:
    """One status per finding: the one that says most, where a finding was verified several times."""
    order = ["unverified", "error", "rate_limited", "verified_inactive", "verified_active"]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("status"))
    best = verifications.groupBy("finding_id").agg(F.max_by("status", rank).alias("status"))
    return findings.join(best, "finding_id", "left")


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row over a batch of repositories."""
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("success"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def commits_with_findings(findings: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return findings.agg(count("commit_hash").alias("commits"))


# ------------------------------------------------------------------ filters
def min_severity(findings: DataFrame, level: str) -> DataFrame:
    """Keep a severity or worse; names without a rank count as lowest."""
    return findings.where(
        classify.severity_rank(F.col("severity")) >= fv.SEVERITY_RANK.get(level.lower(), 0)
    )


def report_view(findings: DataFrame, severity: str | None = None, secret_type: str | None = None) -> DataFrame:
    """Severity-or-worse and exact type, by plain IN so that it reaches a Parquet scan."""
    view = findings
    if severity:
        worse = LEVELS[: LEVELS.index(severity.lower()) + 1]
        view = view.where(F.col("severity").isin(worse))
    if secret_type:
        view = view.where(F.col("secret_type") == secret_type)
    return view


def search_rules(
    catalog: DataFrame, severity: str | None = None, secret_type: str | None = None, search: str | None = None
) -> DataFrame:
    found = catalog
    if severity:
        found = found.where(F.lower("severity") == severity.lower())
    if secret_type:
        found = found.where(F.lower("secret_type") == secret_type.lower())
    if search:
        low = search.lower()
        found = found.where(
            F.lower("name").contains(low) | F.coalesce(F.lower("description").contains(low), F.lit(False))
        )
    return found


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page.  Spark keeps limit + offset rows per task, then merges them."""
    return df.orderBy(*order).offset(offset).limit(limit)


def rule_by_id(catalog: DataFrame, rule_id: str) -> DataFrame:
    return catalog.where(F.translate(F.lower("name"), " -", "__") == rule_id)


def search_repos(repos: DataFrame, query: str) -> DataFrame:
    low = query.lower()
    return repos.where(F.lower("name").contains(low) | F.lower("full_name").contains(low))


def chosen_types(findings: DataFrame, types: list[str]) -> DataFrame:
    return findings.where(F.col("secret_type").isin(types))


def verified(findings: DataFrame, active: bool = True) -> DataFrame:
    return findings.where(F.col("status") == ("verified_active" if active else "verified_inactive"))
