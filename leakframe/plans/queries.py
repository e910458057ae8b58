"""Registered queries: one per operator, over the driver's whole tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import classify, masks, names, text
from leakframe.operators import detect, paths, report, secrets
from leakframe.operators.rules import ScanConfig
from leakframe.plans import oracle as o
from leakframe.plans import pipelines
from leakframe.plans import tables as t
from leakframe.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def doc_judged(spark: SparkSession, d: str) -> DataFrame:
    return detect.scan(t.documents(spark, d), t.RULES, ScanConfig(entropy_enabled=False, with_context=False))


def doc_findings(spark: SparkSession, d: str) -> DataFrame:
    return detect.findings(doc_judged(spark, d))


def cfg_judged(spark: SparkSession, d: str, **options) -> DataFrame:
    return detect.scan(t.config_files(spark, d), t.CONFIG_RULES, ScanConfig(**options))


def cfg_findings(spark: SparkSession, d: str, **options) -> DataFrame:
    return detect.findings(cfg_judged(spark, d, **options))


def history_findings(spark: SparkSession, d: str) -> DataFrame:
    config = ScanConfig(entropy_enabled=False, with_context=False)
    return detect.findings(pipelines.scan_history(t.blobs(spark, d), t.RULES, config))


DOC_F = "WITH " + o.findings(o.DOCS, t.RULES)
DOC_J = "WITH " + o.judged(o.DOCS, t.RULES)
CFG_F = "WITH " + o.findings(o.CONFIGS, t.CONFIG_RULES, entropy_on=True)
CFG_J = "WITH " + o.judged(o.CONFIGS, t.CONFIG_RULES, entropy_on=True)
CFG_FAST = "WITH " + o.findings(o.CONFIGS, t.CONFIG_RULES, profile="fast", entropy_on=True)
HIST_F = "WITH " + o.findings(o.BLOBS, t.RULES)
ITEMS = f"WITH items AS ({o.ITEMS})"
SEV = "(VALUES ('critical'), ('high'), ('medium'), ('low')) v(severity)"


# ------------------------------------------------------------------ detection
@query("WITH " + o.matches(o.DOCS, t.RULES) + " SELECT path, rule_id, match_text, count(*) AS n FROM m GROUP BY ALL")
def match_rules(spark: SparkSession, d: str) -> DataFrame:
    found = detect.find_matches(t.documents(spark, d), t.RULES, ScanConfig(entropy_enabled=False, with_context=False))
    return found.groupBy("path", "rule_id", "match_text").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + o.matches(o.DOCS, t.RULES) + " SELECT path, rule_id, match_start, line_number, column_start, match_text FROM m")
def match_positions(spark: SparkSession, d: str) -> DataFrame:
    found = detect.find_matches(t.documents(spark, d), t.RULES, ScanConfig(entropy_enabled=False, with_context=False))
    return found.select("path", "rule_id", "match_start", "line_number", "column_start", "match_text")


@query("SELECT 'part/' || p_partkey || '.txt' AS path, p_brand || '-' || p_size AS rule_id, length(p_name) + 1 AS match_start, 2 AS line_number, p_brand || ' size ' || p_size AS match_text, p_size::VARCHAR AS size FROM part")
def match_rules_large_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each brand and size that occurs, about a thousand, over a text for each part."""
    parts = t.read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_type")
    kinds = parts.select("p_brand", "p_size").distinct().orderBy("p_brand", "p_size").collect()
    rules = [
        t.Rule(f"{b}-{n}", f"{b} {n}", rf"\b{b} size ({n})\b", "part", "low", ord=i) for i, (b, n) in enumerate(kinds)
    ]
    size = F.col("p_size").cast("string")
    files = parts.select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"),
        F.concat("p_name", F.lit("\n"), "p_brand", F.lit(" size "), size, F.lit("\n"), "p_type").alias("content"),
    )
    found = detect.find_matches(files, rules, ScanConfig(entropy_enabled=False, with_context=False))
    return found.select("path", "rule_id", "match_start", "line_number", "match_text", F.get("groups", F.lit(0)).alias("size"))


@query(DOC_J + " SELECT path, rule_id, line_number, value, round(entropy, 4) AS entropy FROM j")
def entropy_of_values(spark: SparkSession, d: str) -> DataFrame:
    return doc_judged(spark, d).select("path", "rule_id", "line_number", "value", F.round("entropy", 4).alias("entropy"))


@query(DOC_J + """ SELECT path, rule_id, match_start, line_number, column_start, column_start + length(match_text) AS column_end,
  variable_name, actual_value, value_hash, suggested_variable, severity, secret_type, fp_reason FROM j""")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return doc_judged(spark, d).select(
        "path", "rule_id", "match_start", "line_number", "column_start", "column_end", "variable_name",
        "actual_value", "value_hash", "suggested_variable", "severity", "secret_type", "fp_reason",
    )


_PAGE_RULES = [
    t.Rule("link", "Link", r'href="([^"]+)"', "url", "low", "Link", "", 1),
    t.Rule("script_value", "Script Value", r'var\s+\w+\s*=\s*"[^"]*"', "generic_secret", "medium", "Value", "", 2),
    t.Rule("email", "Email Address", r"[a-z0-9._]+@[a-z0-9.]+[a-z0-9]", "username", "medium", "Mail", "", 3),
    t.Rule("style_rule", "Style", r"\{[a-z-]+:[^}]+\}", "generic_secret", "low", "Style", "", 4),
]
_PAGE_J = "WITH " + o.judged(o.PAGES, _PAGE_RULES)


@query(_PAGE_J + " SELECT path, rule_id, match_start, line_number, column_start, value, fp_reason FROM j")
def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    config = ScanConfig(entropy_enabled=False, with_context=False)
    return detect.scan(t.pages(spark, d), _PAGE_RULES, config).select(
        "path", "rule_id", "match_start", "line_number", "column_start", "value", "fp_reason"
    )


@query(
    f"WITH a AS ({_PAGE_J} SELECT rule_id, fp_reason FROM j), b AS ({DOC_J} SELECT rule_id, fp_reason FROM j), "
    f"c AS ({CFG_J} SELECT rule_id, fp_reason FROM j) "
    "SELECT rule_id, fp_reason, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL"
)
def suppressed_by_reason(spark: SparkSession, d: str) -> DataFrame:
    config = ScanConfig(entropy_enabled=False, with_context=False)
    parts = [detect.scan(t.pages(spark, d), _PAGE_RULES, config), doc_judged(spark, d), cfg_judged(spark, d)]
    kept = [p.select("rule_id", "fp_reason") for p in parts]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).groupBy("rule_id", "fp_reason").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + o.judged(o.DOCS, [], entropy_on=True, min_entropy=3.0)
       + " SELECT path, line_number, column_start - 1 AS column_start, value, severity, fp_reason FROM j")
def entropy_candidates(spark: SparkSession, d: str) -> DataFrame:
    config = ScanConfig(min_entropy=3.0, with_context=False)
    return detect.scan(t.documents(spark, d), [], config).select(
        "path", "line_number", "column_start", "value", "severity", "fp_reason"
    )


@query("WITH " + o.judged(o.CONFIGS, [], entropy_on=True)
       + " SELECT path, line_number, column_start - 1 AS column_start, column_start - 1 + length(match_text) AS column_end, value, round(entropy, 4) AS entropy, severity, secret_type, description, fp_reason FROM j")
def entropy_classified(spark: SparkSession, d: str) -> DataFrame:
    return detect.scan(t.config_files(spark, d), [], ScanConfig()).select(
        "path", "line_number", "column_start", "column_end", "value", F.round("entropy", 4).alias("entropy"),
        "severity", "secret_type", "description", "fp_reason",
    )


@query("WITH " + o.judged(o.CONFIGS, [], profile="fast", entropy_on=True)
       + " SELECT path, line_number, value, value_hash, suggested_variable, fp_reason FROM j")
def entropy_fast(spark: SparkSession, d: str) -> DataFrame:
    return detect.scan(t.config_files(spark, d), [], ScanConfig(profile="fast")).select(
        "path", "line_number", "value", "value_hash", "suggested_variable", "fp_reason"
    )


@query(CFG_J + " SELECT path, detector, rule_id, line_number, variable_name, value, suggested_variable, severity, secret_type, fp_reason FROM j")
def scan_configs(spark: SparkSession, d: str) -> DataFrame:
    return cfg_judged(spark, d).select(
        "path", "detector", "rule_id", "line_number", "variable_name", "value", "suggested_variable",
        "severity", "secret_type", "fp_reason",
    )


@query("WITH " + o.judged(o.CONFIGS, t.CONFIG_RULES, profile="fast", entropy_on=True)
       + " SELECT path, detector, rule_id, line_number, variable_name, value, value_hash, suggested_variable, fp_reason FROM j")
def scan_configs_fast(spark: SparkSession, d: str) -> DataFrame:
    return cfg_judged(spark, d, profile="fast").select(
        "path", "detector", "rule_id", "line_number", "variable_name", "value", "value_hash", "suggested_variable", "fp_reason"
    )


@query(CFG_F + f" SELECT path, rule_id, line_number, {o.CONTEXT} AS context FROM f")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return cfg_findings(spark, d).select("path", "rule_id", "line_number", "context")


_JSON_AT = (
    "list_filter(range(1, len(ls) + 1), lambda n: contains(ls[n], value))[1]"
)


@query(
    "WITH fs AS (" + CFG_FAST + " SELECT path, rule_id, line_number, value, secret_type, content, string_split(content, chr(10)) AS ls FROM f), "
    f"located AS (SELECT *, {_JSON_AT} AS i FROM fs), "
    "k AS (SELECT *, nullif(regexp_extract(ls[i], '\"([^\"]+)\"\\s*:\\s*', 1), '') AS json_key, "
    "list_filter(list_transform(range(i - 1, 0, -1), lambda n: nullif(regexp_extract(ls[n], '\"([^\"]+)\"\\s*:\\s*\\{', 1), '')), lambda x: x IS NOT NULL)[1] AS s FROM located), "
    "r AS (SELECT *, CASE WHEN json_key IS NOT NULL THEN s END AS json_section FROM k) "
    "SELECT path, rule_id, line_number, json_section, json_key, regexp_replace('APP_' || coalesce(json_section || '__' || json_key, json_key, "
    f"{o.STEM} || '__' || replace(replace(upper(secret_type), '-', '_'), ' ', '_')), '[^A-Za-z0-9_]', '_', 'g') AS env_var FROM r"
)
def json_location(spark: SparkSession, d: str) -> DataFrame:
    named = pipelines.dotnet_named(cfg_findings(spark, d, profile="fast", with_json=True, with_context=False))
    return named.select("path", "rule_id", "line_number", "json_section", "json_key", "env_var")


# ------------------------------------------------------------------ paths
_GLOBS = ScanConfig(
    file_includes=["**/*.py", "**/*.js", "**/*.yml", "**/*.json", "res/*.xml"],
    file_excludes=["**/node_modules/**", "readme"],
    path_allowlist=[r"svc\d*7/"],
)


@query(
    f"WITH files AS ({o.CONFIGS}) SELECT path FROM files WHERE NOT lower({o.SUFFIX}) IN {o.in_list(fv.SKIP_EXTENSIONS)} "
    "AND NOT regexp_matches(path, 'svc[0-9]*7/') AND NOT (path LIKE '.git/%' OR contains(path, '/.git/')) "
    "AND NOT list_contains(string_split(path, '/'), 'node_modules') AND NOT contains(path, 'readme') "
    "AND (path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.yml' OR path LIKE '%.json' OR regexp_matches(path, '(^|/)res/[^/]*\\.xml$'))"
)
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    return paths.keep_scannable(t.config_files(spark, d), _GLOBS).select("path")


@query(
    f"WITH files AS ({o.CONFIGS}) SELECT path, lower({o.SUFFIX}) IN {o.in_list(fv.FAST_SKIP_EXTENSIONS)} OR {o.hit('lower(path)', fv.FAST_SKIP_PATH)} AS fast_skipped, "
    f"{o.HISTORY_SKIPPED} AS history_skipped FROM files"
)
def path_skips(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return t.config_files(spark, d).select(
        "path", paths.fast_skipped(p).alias("fast_skipped"), paths.history_skipped(p).alias("history_skipped")
    )


@query(f"WITH files AS ({o.CONFIGS}) SELECT path, {o.FILE_CLASS} AS file_class, {o.LANGUAGE} AS language, lower({o.SUFFIX}) AS ext, {o.STEM} AS stem FROM files")
def file_class(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return t.config_files(spark, d).select(
        "path", classify.file_class(p).alias("file_class"), classify.language(p).alias("language"),
        text.extension(p).alias("ext"), text.stem(p).alias("stem"),
    )


@query(f"WITH files AS ({o.DOCS} UNION ALL {o.PAGES}) SELECT path, size_bytes FROM files WHERE size_bytes <= 8000")
def size_filter(spark: SparkSession, d: str) -> DataFrame:
    both = t.documents(spark, d).unionByName(t.pages(spark, d))
    return paths.keep_scannable(both, ScanConfig(max_file_size=8000)).select("path", "size_bytes")


# ------------------------------------------------------------------ masks and names
@query(CFG_J + " SELECT path, rule_id, line_number, " + ", ".join(f"{o.mask('value', s)} AS {s}" for s in masks.STYLES) + " FROM j")
def masked_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return cfg_judged(spark, d).select("path", "rule_id", "line_number", *[masks.mask(v, s).alias(s) for s in masks.STYLES])


@query(CFG_J + f" SELECT {o.shape('value')} AS shape, count(*) AS n FROM j GROUP BY 1")
def value_shapes(spark: SparkSession, d: str) -> DataFrame:
    return cfg_judged(spark, d).groupBy(masks.shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(CFG_J + " SELECT left(sha256(path || ':' || line_number || ':' || exposed_value), 32) AS fingerprint, sha256(value || ':' || path) AS job_hash, value_hash FROM j")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return cfg_judged(spark, d).select(
        masks.fingerprint(F.col("path"), F.col("line_number"), F.col("exposed_value")).alias("fingerprint"),
        masks.job_hash(F.col("value"), F.col("path")).alias("job_hash"), "value_hash",
    )


_KEYWORD = o.case((f"contains(lower(value), {o.lit(k)})", o.lit(v)) for k, v in fv.VALUE_KEYWORDS)
_TYPE_WORD = "replace(replace(upper(secret_type), '-', '_'), ' ', '_')"
_USEFUL = lambda e: f"CASE WHEN upper({e}) NOT IN {o.in_list([*fv.HISTORY_GENERIC_NAMES, ''])} THEN upper({e}) END"
HISTORY_NAME = (
    "replace(replace('APP_' || array_to_string(list_filter([" + ", ".join([_USEFUL(o.PARENT), _USEFUL(o.STEM), _KEYWORD])
    + f"], lambda x: x IS NOT NULL)[1:2] || [{o.lookup('secret_type', fv.HISTORY_ENV_BY_TYPE, _TYPE_WORD)}, upper(left(sha256(value), 4))], '_'), '__', '_'), '-', '_')"
)
OLD_NAME = (
    f"'APP_' || CASE WHEN {o.lookup('secret_type', fv.HISTORY_ENV_BY_TYPE, _TYPE_WORD)} = 'SECRET' AND upper({o.STEM}) NOT IN {o.in_list([*fv.OLD_GENERIC_STEMS, ''])} "
    f"THEN upper({o.STEM}) || '_SECRET' ELSE {o.lookup('secret_type', fv.HISTORY_ENV_BY_TYPE, _TYPE_WORD)} END"
)
CI_NAME = (
    f"regexp_replace(regexp_replace(regexp_replace(replace(replace({o.STEM}, '.', '_'), '-', '_') || '__' || regexp_replace(secret_type, '[^a-zA-Z0-9]', '_', 'g'), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
)


@query(CFG_J + f""" SELECT path, rule_id, line_number, {HISTORY_NAME} AS history_name, {OLD_NAME} AS old_name, {CI_NAME} AS ci_name,
  'APP_' || {o.lookup('secret_type', fv.REPORT_ENV_BY_TYPE, 'upper(secret_type)')} AS report_name,
  regexp_replace(upper(regexp_replace(coalesce(suggested_variable, 'none'), '^APP_', '')), '[^A-Za-z0-9_]', '_', 'g') AS clean_name FROM j""")
def env_names(spark: SparkSession, d: str) -> DataFrame:
    kind, p = F.col("secret_type"), F.col("path")
    return cfg_judged(spark, d).select(
        "path", "rule_id", "line_number",
        names.history_env_name(F.col("value"), kind, p).alias("history_name"),
        names.history_env_name_old(kind, p).alias("old_name"),
        names.ci_name(F.lit(""), F.lit(""), kind, p).alias("ci_name"),
        names.report_env_name(kind).alias("report_name"),
        names.sanitize(F.coalesce("suggested_variable", F.lit("none"))).alias("clean_name"),
    )


@query(CFG_F + f""", b AS (SELECT finding_key, base FROM (SELECT path || ':' || rule_id || ':' || line_number AS finding_key,
  'APP_' || {o.lookup('secret_type', fv.GENERATED_ENV_BY_TYPE, o.lit('SECRET_VALUE'))} AS base FROM f)),
  n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY finding_key) - 1 AS i FROM b)
  SELECT finding_key, base, CASE WHEN i = 0 THEN base ELSE base || '_' || i END AS env_var FROM n""")
def env_names_unique(spark: SparkSession, d: str) -> DataFrame:
    keyed = cfg_findings(spark, d, with_context=False).select(
        F.concat_ws(":", "path", "rule_id", F.col("line_number").cast("string")).alias("finding_key"),
        names.generated_env_name(F.col("secret_type")).alias("base"),
    )
    return names.make_unique(keyed, "base", ["finding_key"])


@query(CFG_J + r""" SELECT path, rule_id, line_number, coalesce(nullif(regexp_extract(exposed_value, '^[\pL\pN_]+["'']?\s*:\s*["''](.+?)["'']?$', 1), ''),
  nullif(regexp_extract(exposed_value, '^[\pL\pN_]+\s*=\s*["''](.+?)["'']$', 1), ''), exposed_value) AS clean FROM j""")
def clean_values(spark: SparkSession, d: str) -> DataFrame:
    return cfg_judged(spark, d).select("path", "rule_id", "line_number", names.clean_value(F.col("exposed_value")).alias("clean"))


# ------------------------------------------------------------------ classes
@query(f"WITH c AS ({o.CATALOG}) SELECT name, {o.case(((f'contains(lower(name), {o.lit(k)})', o.lit(v)) for k, v in fv.TYPE_BY_RULE_NAME), o.lit('other'))} AS kind, "
       "CASE WHEN contains(lower(name), 'password') THEN 'password' WHEN contains(lower(name), 'api') OR contains(lower(name), 'key') THEN 'api_key' "
       "WHEN contains(lower(name), 'token') THEN 'token' WHEN contains(lower(name), 'private') THEN 'private_key' WHEN contains(lower(name), 'connection') THEN 'connection_string' ELSE 'other' END AS coarse FROM c")
def rule_types(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return t.rule_catalog(spark, d).select("name", classify.type_of_rule_name(n).alias("kind"), classify.coarse_type(n).alias("coarse"))


_SUGGESTED = "lower(coalesce(suggested_variable, ''))"


@query(CFG_F + f" SELECT path, rule_id, line_number, {o.CONTENT_CATEGORY} AS category, {o.TYPE_CATEGORY} AS type_category, "
       + o.case(((o.contains_any("lower(secret_type)", w), o.lit(g)) for g, w in fv.ENV_FILE_GROUPS), "'other'") + " AS env_group, "
       f"CASE WHEN contains({_SUGGESTED}, 'connection') OR contains(lower(secret_type), 'connectionstring') THEN 'connection_strings' "
       f"WHEN contains({_SUGGESTED}, 'api') OR contains(lower(secret_type), 'apikey') THEN 'api_keys' "
       f"WHEN {o.contains_any(_SUGGESTED, ['auth', 'oauth', 'client_secret', 'password', 'token'])} THEN 'authentication' "
       f"WHEN {o.contains_any(_SUGGESTED, ['key', 'private', 'secret', 'encrypt'])} THEN 'encryption_keys' ELSE 'other' END AS ci_group "
       f"FROM (SELECT *, {o.CONTEXT} AS context FROM f)")
def finding_classes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("secret_type")
    return cfg_findings(spark, d).select(
        "path", "rule_id", "line_number",
        classify.finding_category(kind, F.col("context"), F.col("exposed_value")).alias("category"),
        classify.type_category(kind).alias("type_category"),
        classify.env_file_group(kind).alias("env_group"),
        classify.ci_group(F.coalesce("suggested_variable", F.lit("")), kind).alias("ci_group"),
    )


def _tech_sql() -> str:
    parts = []
    for tech, patterns in fv.TECH_IN_TEXT.items():
        anchored = [p for p in patterns if p.endswith("$")]
        free = [p for p in patterns if not p.endswith("$")]
        conds = ([o.hit("blob", free)] if free else []) + ([o.hit("path", anchored)] if anchored else [])
        parts.append(f"SELECT DISTINCT repo, {o.lit(tech)} AS technology FROM b WHERE {' OR '.join(conds)}")
    return " UNION ALL ".join(parts)


@query(CFG_F + f", b AS (SELECT repo, path, ' ' || path || ' ' || {o.CONTEXT} || ' ' || exposed_value AS blob FROM f) " + _tech_sql())
def technologies_in_findings(spark: SparkSession, d: str) -> DataFrame:
    return classify.technologies_in_findings(cfg_findings(spark, d))


@query(
    f"WITH files AS ({o.CONFIGS}) SELECT DISTINCT repo, 'Docker' AS technology FROM files WHERE path LIKE '%/Dockerfile' "
    "UNION ALL SELECT DISTINCT repo, '.NET Configuration' FROM files WHERE regexp_matches(path, '(^|/)appsettings[^/]*\\.json$')"
)
def technologies_in_tree(spark: SparkSession, d: str) -> DataFrame:
    return classify.technologies_in_tree(t.config_files(spark, d).drop("custkey"))


# ------------------------------------------------------------------ unique secrets
@query(HIST_F + """ SELECT repo, value_hash, arg_min(value, (commit_seq, path, rule_ord, match_start)) AS value,
  arg_min(secret_type, (commit_seq, path, rule_ord, match_start)) AS secret_type, arg_min(severity, (commit_seq, path, rule_ord, match_start)) AS severity,
  arg_min(path, (commit_seq, path, rule_ord, match_start)) AS path, count(*) AS n_matches, count(DISTINCT path) AS n_files, count(DISTINCT commit_hash) AS n_commits,
  min(commit_ts) AS first_seen, max(commit_ts) AS last_seen FROM f GROUP BY 1, 2""")
def unique_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.fold(history_findings(spark, d)).select(
        "repo", "value_hash", "value", "secret_type", "severity", "path", "n_matches", "n_files", "n_commits", "first_seen", "last_seen"
    )


@query(HIST_F + f""", u AS (SELECT repo, value_hash, arg_min(value, (commit_seq, path, rule_ord, match_start)) AS value,
  arg_min(secret_type, (commit_seq, path, rule_ord, match_start)) AS secret_type, arg_min(path, (commit_seq, path, rule_ord, match_start)) AS path FROM f GROUP BY 1, 2)
  SELECT repo, value_hash, {HISTORY_NAME} AS env_var, '${{' || {HISTORY_NAME} || '}}' AS replacement FROM u""")
def named_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.name_secrets(secrets.fold(history_findings(spark, d))).select("repo", "value_hash", "env_var", "replacement")


_ONCE = "SELECT path, commit_hash, rule_id, match_start, line_number, value_hash, fp_reason FROM j"


@query("WITH " + o.judged(o.BLOBS, t.RULES) + " " + _ONCE)
def history_scanned_once(spark: SparkSession, d: str) -> DataFrame:
    revisions, contents = pipelines.split_blobs(t.blobs(spark, d))
    config = ScanConfig(entropy_enabled=False, with_context=False)
    return pipelines.scan_history_once(revisions, contents, t.RULES, config).select(
        "path", "commit_hash", "rule_id", "match_start", "line_number", "value_hash", "fp_reason"
    )


@query(HIST_F + " SELECT repo, value_hash, commit_hash, min(commit_seq) AS commit_seq FROM f GROUP BY 1, 2, 3")
def secret_commits(spark: SparkSession, d: str) -> DataFrame:
    return secrets.places(history_findings(spark, d), "commit_hash").select(
        "repo", "value_hash", "commit_hash", F.col("first_ord.commit_seq").alias("commit_seq")
    )


@query(HIST_F + """, p AS (SELECT repo, value_hash, path, min((commit_seq, path, rule_ord, match_start)) AS o FROM f GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY repo, value_hash ORDER BY o) AS k FROM p)
  SELECT repo, value_hash, string_agg(path, ', ' ORDER BY o) AS files FROM r WHERE k <= 3 GROUP BY 1, 2""")
def first_files(spark: SparkSession, d: str) -> DataFrame:
    top = secrets.first_places(history_findings(spark, d), "path", 3)
    return top.select("repo", "value_hash", F.array_join("first_paths", ", ").alias("files"))


@query(DOC_F + """ SELECT repo, value, arg_min(secret_type, (path, line_number, rule_ord, match_start)) AS secret_type,
  arg_min(path, (path, line_number, rule_ord, match_start)) AS path, count(DISTINCT path) AS n_files FROM f GROUP BY 1, 2""")
def value_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = secrets.value_fold(doc_findings(spark, d))
    return folded.select("repo", "value", "secret_type", "path", "n_files")


@query(DOC_F + f" SELECT repo, sha256(value || ':' || path) AS secret_value_hash, min(path) AS path, min(line_number) AS line_number, count(*) AS occurrence_count, min({o.mask('value', 'task')}) AS value_preview FROM f GROUP BY 1, 2")
def job_dedup(spark: SparkSession, d: str) -> DataFrame:
    return secrets.job_dedup(doc_findings(spark, d)).drop("secret_type")


@query(DOC_F + " SELECT value, min(path) AS first_path FROM f WHERE value <> '' GROUP BY 1")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.distinct_values(doc_findings(spark, d), ["path", "line_number", "match_start"])
    return found.select("value", F.col("first_ord.path").alias("first_path"))


@query(HIST_F + ", u AS (SELECT repo, value_hash, path FROM f GROUP BY 1, 2, 3), t AS (SELECT repo, value_hash, arg_min(secret_type, (commit_seq, path, rule_ord, match_start)) AS secret_type FROM f GROUP BY 1, 2) SELECT repo, value_hash, u.path, secret_type FROM u JOIN t USING (repo, value_hash)")
def secrets_per_file(spark: SparkSession, d: str) -> DataFrame:
    found = cut_lineage(history_findings(spark, d))
    return secrets.per_file(secrets.fold(found), secrets.places(found, "path")).select("repo", "value_hash", "path", "secret_type")


@query(HIST_F + " SELECT repo, path, count(*) AS n_findings FROM f WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels l USING (doc_id) WHERE x.lang = f.repo AND 'docs/' || x.doc_id || '.md' = f.path) GROUP BY 1, 2")
def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = t.read(spark, d, "documents", "doc_id", "lang"), t.read(spark, d, "labels", "doc_id")
    tracked = docs.join(labels, "doc_id").select(
        F.col("lang").alias("repo"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    )
    return secrets.deleted_files(history_findings(spark, d), tracked)


_PARTIAL_SQL = (
    "WITH s AS (SELECT 'Server=' || c_name || ';Password=' || left(sha256(c_name), 14) || ';' AS value, 'connection_string_full' AS secret_type FROM customer "
    "UNION ALL SELECT left(sha256(c_name), 14), 'database_password' FROM customer "
    "UNION ALL SELECT right(c_name, 5), 'sqlserver' FROM customer "
    "UNION ALL SELECT right(sha256(c_name), 14), 'database_password' FROM customer "
    "UNION ALL SELECT s_name, 'api_key' FROM supplier)"
)


def _partial_secrets(spark: SparkSession, d: str) -> DataFrame:
    c, h = t.read(spark, d, "customer", "c_name"), F.sha2("c_name", 256)
    row = lambda v, kind: F.struct(v.alias("value"), F.lit(kind).alias("secret_type"))
    made = c.select(
        F.inline(
            F.array(
                row(F.concat(F.lit("Server="), "c_name", F.lit(";Password="), F.substring(h, 1, 14), F.lit(";")), "connection_string_full"),
                row(F.substring(h, 1, 14), "database_password"),
                row(F.right("c_name", F.lit(5)), "sqlserver"),
                row(F.right(h, F.lit(14)), "database_password"),
            )
        )
    )
    return made.unionByName(t.read(spark, d, "supplier").select(F.col("s_name").alias("value"), F.lit("api_key").alias("secret_type")))


@query(_PARTIAL_SQL + f""" SELECT value, secret_type FROM s WHERE NOT (secret_type IN {o.in_list(sorted(fv.PARTIAL_VALUE_TYPES))} AND value <> ''
  AND EXISTS (SELECT 1 FROM s b WHERE b.secret_type IN {o.in_list(sorted(fv.FULL_VALUE_TYPES))} AND length(b.value) > length(s.value) AND contains(b.value, s.value)))""")
def partial_covered(spark: SparkSession, d: str) -> DataFrame:
    return secrets.drop_covered_partials(_partial_secrets(spark, d))


# ------------------------------------------------------------------ comparing scans
_EVEN = "commit_seq % 2 = 0"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = cut_lineage(history_findings(spark, d))
    return found.where("branch = 'main'"), found.where("branch <> 'main'")


_HALVES = HIST_F + ", b AS (SELECT * FROM f WHERE branch = 'main'), c AS (SELECT * FROM f WHERE branch <> 'main')"


@query(_HALVES + ", x AS (SELECT value, max(side = 'b') AS b, max(side = 'c') AS c FROM (SELECT value, 'b' AS side FROM b UNION ALL SELECT value, 'c' FROM c) GROUP BY 1) "
       "SELECT value, CASE WHEN NOT c THEN 'cleaned' WHEN b THEN 'remaining' ELSE 'new' END AS status FROM x")
def compare_scans(spark: SparkSession, d: str) -> DataFrame:
    return secrets.compare(*_halves(spark, d))


@query(_HALVES + """ SELECT (SELECT count(*) FROM b) AS baseline_total, (SELECT count(*) FROM c) AS current_total,
  (SELECT count(*) FROM (SELECT value FROM b EXCEPT SELECT value FROM c)) AS unique_cleaned,
  (SELECT count(*) FROM (SELECT value FROM b INTERSECT SELECT value FROM c)) AS unique_remaining,
  (SELECT count(*) FROM (SELECT value FROM c EXCEPT SELECT value FROM b)) AS new_findings,
  round((SELECT count(*) FROM (SELECT value FROM b EXCEPT SELECT value FROM c)) * 100.0 / (SELECT count(DISTINCT value) FROM b), 4) AS cleanup_percentage""")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return secrets.compare_summary(*_halves(spark, d)).withColumn("cleanup_percentage", F.round("cleanup_percentage", 4))


@query(_HALVES + f""", n AS (SELECT severity, (SELECT count(*) FROM b WHERE b.severity = v.severity) AS before, (SELECT count(*) FROM c WHERE c.severity = v.severity) AS after FROM {SEV})
  SELECT severity, before, after, before - after AS change, CASE WHEN before > 0 THEN round((before - after) * 100.0 / before) ELSE 0.0 END AS percent FROM n""")
def severity_change(spark: SparkSession, d: str) -> DataFrame:
    return secrets.severity_change(*_halves(spark, d))


@query(_HALVES + " SELECT path, rule_id, match_start, value, value IN (SELECT value FROM b) AS was_purged FROM c")
def verify_clean(spark: SparkSession, d: str) -> DataFrame:
    baseline, rescan = _halves(spark, d)
    return secrets.verify_clean(rescan, baseline).select("path", "rule_id", "match_start", "value", "was_purged")


@query(
    f"WITH a AS ({DOC_F} SELECT path, value_hash FROM f), b AS ({HIST_F} SELECT path, value_hash, commit_hash FROM f) "
    "SELECT path, value_hash, NULL AS commit_hash FROM a UNION ALL SELECT path, value_hash, commit_hash FROM b"
)
def with_history(spark: SparkSession, d: str) -> DataFrame:
    return secrets.append_history(doc_findings(spark, d), history_findings(spark, d)).select("path", "value_hash", "commit_hash")


# ------------------------------------------------------------------ reports
@query(DOC_F + f" SELECT v.severity, count(f.severity) AS n FROM {SEV} LEFT JOIN f ON f.severity = v.severity GROUP BY 1")
def by_severity(spark: SparkSession, d: str) -> DataFrame:
    return report.severity_counts(doc_findings(spark, d))


@query(DOC_J + " SELECT " + ", ".join(f"count(*) FILTER (fp_reason IS NULL AND severity = '{s}') AS {s}" for s in fv.SEVERITIES) + ", count(*) FILTER (fp_reason IS NULL) AS total FROM j")
def result_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.result_counts(doc_judged(spark, d))


@query(DOC_F + " SELECT secret_type, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, secret_type LIMIT 10")
def top_types(spark: SparkSession, d: str) -> DataFrame:
    return report.type_counts(doc_findings(spark, d), 10)


@query(DOC_F + " SELECT repo, path, count(*) AS n, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in fv.SEVERITIES[:4]) + " FROM f GROUP BY 1, 2 ORDER BY n DESC, repo, path LIMIT 50")
def files_top(spark: SparkSession, d: str) -> DataFrame:
    return report.file_counts(doc_findings(spark, d), 50)


@query(CFG_F + f", g AS (SELECT {o.TYPE_CATEGORY} AS category, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM f GROUP BY 1) "
       "SELECT *, CASE WHEN critical > 0 THEN 'urgent' WHEN high > 0 THEN 'high' ELSE 'medium' END AS priority FROM g")
def category_priority(spark: SparkSession, d: str) -> DataFrame:
    return report.category_table(cfg_findings(spark, d, with_context=False))


@query(CFG_F + f" SELECT {o.CONTENT_CATEGORY} AS category, count(*) AS findings FROM (SELECT *, {o.CONTEXT} AS context FROM f) GROUP BY 1")
def content_categories(spark: SparkSession, d: str) -> DataFrame:
    return report.content_categories(cfg_findings(spark, d))


@query(CFG_F + f", g AS (SELECT {o.TYPE_CATEGORY} AS category, repo, path, count(*) AS findings, list_sort(list_distinct(list(line_number))) AS ls FROM f GROUP BY 1, 2, 3) "
       "SELECT category, repo, path, findings, len(ls) AS distinct_lines, array_to_string(ls[1:10], ', ') AS lines FROM g")
def lines_per_file(spark: SparkSession, d: str) -> DataFrame:
    return report.lines_per_file(cut_lineage(cfg_findings(spark, d, with_context=False)))


@query(HIST_F + " SELECT count(DISTINCT value_hash) AS secrets, count(DISTINCT (repo, path)) AS files, count(DISTINCT commit_hash) AS commits FROM f")
def preclean_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.preclean_totals(history_findings(spark, d))


@query(HIST_F + " SELECT secret_type, count(DISTINCT value_hash) AS secrets, count(DISTINCT (repo, path)) AS files, count(DISTINCT commit_hash) AS commits FROM f GROUP BY 1")
def by_type_distinct(spark: SparkSession, d: str) -> DataFrame:
    return report.preclean_by_type(history_findings(spark, d))


@query(HIST_F + " SELECT repo, path, count(DISTINCT value_hash) AS secrets, array_to_string(list_sort(list_distinct(list(secret_type))), ', ') AS types FROM f GROUP BY 1, 2 ORDER BY secrets DESC, repo, path LIMIT 20")
def preclean_top_files(spark: SparkSession, d: str) -> DataFrame:
    return report.preclean_top_files(history_findings(spark, d))


@query(CFG_F + f" SELECT coalesce(nullif({o.SUFFIX}, ''), 'other') AS ext, count(DISTINCT (repo, path)) AS files FROM f GROUP BY 1 ORDER BY files DESC, ext LIMIT 5")
def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.extension_counts(cfg_findings(spark, d, with_context=False))


@query(f"WITH x AS ({o.OBJECTS}) SELECT coalesce(path, sha) AS path, max(size_bytes) AS size_bytes FROM x WHERE type = 'blob' AND size_bytes > 4000 GROUP BY 1")
def large_objects(spark: SparkSession, d: str) -> DataFrame:
    return report.large_objects(t.objects(spark, d), 4000)


@query(f"""WITH x AS ({o.BLOBS}) SELECT repo, count(DISTINCT commit_hash) AS total_commits, count(DISTINCT branch) AS total_branches,
  count(DISTINCT branch) FILTER (NOT starts_with(branch, 'remotes/')) AS local_branches, count(DISTINCT branch) FILTER (starts_with(branch, 'remotes/')) AS remote_branches,
  min(commit_ts)::DATE AS first_commit_date, max(commit_ts)::DATE AS last_commit_date,
  round(date_diff('day', min(commit_ts)::DATE, max(commit_ts)::DATE) / 365.25, 4) AS history_years, sum(strlen(content))::BIGINT AS size_bytes FROM x GROUP BY 1""")
def repo_metrics(spark: SparkSession, d: str) -> DataFrame:
    return report.repo_metrics(t.blobs(spark, d)).withColumn("history_years", F.round("history_years", 4))


@query(f"WITH c AS ({o.CATALOG}) SELECT 'severity' AS dimension, severity AS name, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'type', secret_type, count(*) FROM c GROUP BY 2")
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.rule_summary(t.rule_catalog(spark, d))


@query(f"WITH c AS ({o.CATALOG}) SELECT ord, name, severity FROM c WHERE severity = 'high' AND (contains(lower(name), 'red') OR contains(lower(description), '#1')) ORDER BY ord LIMIT 20 OFFSET 5")
def rule_search(spark: SparkSession, d: str) -> DataFrame:
    red = report.search_rules(t.rule_catalog(spark, d), severity="High", search="red")
    one = report.search_rules(t.rule_catalog(spark, d), severity="High", search="#1")
    return report.page(red.unionByName(one).distinct(), ["ord"], 20, 5).select("ord", "name", "severity")


@query(f"WITH c AS ({o.CATALOG}) SELECT ord, name FROM c WHERE replace(replace(lower(name), ' ', '_'), '-', '_') = 'red_widget_1'")
def rule_lookup(spark: SparkSession, d: str) -> DataFrame:
    return report.rule_by_id(t.rule_catalog(spark, d), "red_widget_1").select("ord", "name")


@query(DOC_F + " SELECT path, rule_id, match_start, severity FROM f WHERE severity IN ('critical', 'high')")
def min_severity(spark: SparkSession, d: str) -> DataFrame:
    return report.min_severity(doc_findings(spark, d), "high").select("path", "rule_id", "match_start", "severity")


@query(DOC_F + " SELECT path, match_start, severity FROM f WHERE severity IN ('critical', 'high', 'medium') AND secret_type = 'username'")
def report_view(spark: SparkSession, d: str) -> DataFrame:
    return report.report_view(doc_findings(spark, d), "medium", "username").select("path", "match_start", "severity")


@query(DOC_F + " SELECT path, secret_type, match_start FROM f WHERE secret_type IN ('auth_token', 'ip_address')")
def chosen_types(spark: SparkSession, d: str) -> DataFrame:
    return report.chosen_types(doc_findings(spark, d), ["auth_token", "ip_address"]).select("path", "secret_type", "match_start")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '99') OR contains(lower(c_mktsegment || '/' || c_name), 'build') ORDER BY c_name LIMIT 30")
def repo_search(spark: SparkSession, d: str) -> DataFrame:
    repos = t.read(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        "c_custkey", F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("/"), "c_name").alias("full_name")
    )
    found = report.search_repos(repos, "99").unionByName(report.search_repos(repos, "build")).distinct()
    return report.page(found, ["name"], 30).select("c_custkey", F.col("name").alias("c_name"))


@query(HIST_F + " SELECT count(DISTINCT commit_hash) AS commits FROM f")
def commits_with_findings(spark: SparkSession, d: str) -> DataFrame:
    return report.commits_with_findings(history_findings(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM events")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.batch_summary(t.events(spark, d).select((F.col("event_type") != "error").alias("success")))


@query(DOC_F + " SELECT CASE WHEN bool_or(severity = 'critical') THEN 2 WHEN bool_or(severity = 'high') THEN 1 ELSE 0 END AS exit_code FROM f")
def exit_code(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.exit_code(doc_findings(spark, d))
