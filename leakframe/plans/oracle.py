"""SQL texts that say the same as the registered queries, for a second engine to run.

The second engine has another regex dialect (no look-around, ASCII ``\\b``), so patterns pass
through ``re2`` and the registered rules stay in the shared subset.
"""

from __future__ import annotations

from leakframe import fixed_values as fv
from leakframe.functions.regex import rewrite
from leakframe.operators.rules import Rule
from leakframe.plans.tables import CONFIG_PATHS

_WORD, _DIGIT, _SPACE = r"\pL\pN_", r"\p{Nd}", r"\s\x0b\x1c-\x1f\x{85}\pZ"
_OUT = {"w": f"[{_WORD}]", "W": f"[^{_WORD}]", "d": f"[{_DIGIT}]", "D": f"[^{_DIGIT}]",
        "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]"}
_IN = {"w": _WORD, "d": _DIGIT, "s": _SPACE}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flag: str = "i") -> str:
    return lit((f"(?{flag})" if flag else "") + rewrite(pattern, _OUT, _IN))


def hit(col: str, patterns: list[str] | str, flag: str = "i") -> str:
    patterns = [patterns] if isinstance(patterns, str) else patterns
    return f"regexp_matches({col}, {re2('|'.join(f'(?:{p})' for p in patterns), flag)})"


def group(col: str, pattern: str, idx: int = 1, flag: str = "i") -> str:
    return f"nullif(regexp_extract({col}, {re2(pattern, flag)}, {idx}), '')"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def case(pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def lookup(col: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def contains_any(col: str, items: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(i)})" for i in items) + ")"


def entropy(v: str) -> str:
    p = f"((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE)"
    return (
        f"CASE WHEN {v} = '' THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({v}, '')), "
        f"lambda c: {p} * log2({p}))) END"
    )


# ------------------------------------------------------------------ paths
BASE = "list_last(string_split(path, '/'))"
SUFFIX = f"regexp_extract({BASE}, '(?s)^.+(\\.[^.]+)$', 1)"
STEM = f"left({BASE}, length({BASE}) - length({SUFFIX}))"
PARENT = "CASE WHEN contains(path, '/') THEN string_split(path, '/')[-2] ELSE '' END"


# ------------------------------------------------------------------ inputs
DOCS = (
    "SELECT lang AS repo, source || '/' || doc_id || '.txt' AS path, text AS content, "
    "strlen(text) AS size_bytes FROM documents"
)
PAGES = (
    "SELECT 'web' AS repo, 'site/' || page_id || '.html' AS path, html AS content, "
    "strlen(html) AS size_bytes FROM pages"
)
BLOBS = (
    "SELECT lang AS repo, CASE WHEN substr(source, 4)::BIGINT % 2 = 0 THEN 'main' ELSE 'remotes/dev' END AS branch, "
    "left(sha256(source), 40) AS commit_hash, substr(source, 4)::BIGINT AS commit_seq, "
    "TIMESTAMP '2024-01-01' + to_days(substr(source, 4)::INT) AS commit_ts, "
    "'docs/' || doc_id || '.md' AS path, text AS content FROM documents"
)
_H = "sha256(c_name)"
_KINDS = "[" + ", ".join(lit(p) for p in CONFIG_PATHS) + "]"
CONFIGS = (
    "SELECT c_mktsegment AS repo, c_custkey AS custkey, "
    f"'svc' || c_custkey || '/' || ({_KINDS})[(c_custkey % {len(CONFIG_PATHS)} + 1)::INT] AS path, "
    "concat_ws(chr(10), '{', '  \"' || c_mktsegment || '\": {', "
    f"'    \"ClientKey\": \"' || substr({_H}, 1, 32) || '\",', "
    "'    \"Owner\": \"' || c_name || '\"', '  }', '}', "
    f"'AWS_ACCESS_KEY_ID = \"AKIA' || upper(substr({_H}, 1, 16)) || '\"', "
    f"'db.password = \"' || substr({_H}, 17, 14) || '\"; // primary', "
    f"'const apiKey = \"sk_live_' || substr({_H}, 20, 24) || '\"', "
    f"'github: ghp_' || substr({_H}, 5, 36), "
    f"'SECRET = \"' || base64(from_hex({_H})) || '\"', "
    "'home = \"https://docs.example.com/' || c_custkey || '\"') AS content FROM customer"
)
ITEMS = (
    "SELECT source AS submission_id, TIMESTAMP '2024-01-01' + to_days(substr(source, 4)::INT) AS received_at, "
    "value, sha256(value) AS value_hash, "
    "CASE WHEN toxic = 1 THEN 'password' ELSE 'api_key' END AS secret_type, 'high' AS severity, "
    "lang || '/' || doc_id || CASE WHEN toxic = 1 THEN '.yml' ELSE '.py' END AS path, quality = 1 AS is_true_positive "
    "FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS value FROM documents JOIN labels USING (doc_id))"
)
JOBS = (
    "SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' "
    "WHEN 'P' THEN 'scanning' ELSE 'pending' END AS status, o_orderdate AS created_at, "
    "o_orderdate + INTERVAL 7 DAY AS expires_at, coalesce(n, 0) AS total_secrets_found, "
    "coalesce(r, 0) AS secrets_selected_for_cleaning FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, "
    "count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
)
JOB_SECRETS = (
    "SELECT l_orderkey AS job_id, l_linenumber AS id, l_partkey AS part, l_returnflag = 'N' AS is_false_positive, "
    "l_returnflag = 'R' AS selected_for_cleaning FROM lineitem"
)
OUTBOX = (
    "SELECT event_id AS id, event_id, event_type, user_id AS aggregate_id, props AS payload, value > 20 AS published, "
    "CASE WHEN value > 20 THEN ts END AS published_at, "
    "coalesce(json_extract_string(props, '$.k')::INT % 7, 0) AS retry_count, ts AS created_at FROM events"
)
CATALOG = (
    "SELECT p_partkey AS ord, p_name || '-' || p_partkey AS name, lower(p_type) AS secret_type, "
    "CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 25 THEN 'high' WHEN p_size > 10 THEN 'medium' "
    "ELSE 'low' END AS severity, p_brand AS description FROM part"
)
OBJECTS = (
    "SELECT 'd' || doc_id AS sha, source AS path, 'blob' AS type, strlen(text) AS size_bytes FROM documents "
    "UNION ALL SELECT 'p' || page_id, NULL, CASE WHEN page_id % 5 = 0 THEN 'tree' ELSE 'blob' END, strlen(html) FROM pages"
)


# ------------------------------------------------------------------ detection
def matches(files: str, rules: list[Rule], entropy_rule: str | None = None) -> str:
    """CTE chain ending in ``m``: every match with its position and the line it is on.

    ``entropy_rule`` is 'full' or 'fast' to add the candidates of the entropy operator."""
    parts = []
    specs = [(r.rule_id, "rule", r.ord, re2(r.regex, "im"), r.compiled().groups) for r in rules]
    last = max((r.ord for r in rules), default=0) + 1
    extra = ""
    if entropy_rule == "full":
        low = "lower(path)"
        extra = f" AND NOT ({contains_any(low, fv.ENTROPY_PATH_SKIP)} OR {low} LIKE '%.js')"
        specs.append(("entropy", "entropy", last, re2(fv.QUOTED_CANDIDATE, ""), 1))
    elif entropy_rule == "fast":
        specs.append(("entropy", "entropy", last, re2(fv.BARE_CANDIDATE, ""), 0))
    for rule_id, detector, order, rx, n_groups in specs:
        groups = ", ".join(f"regexp_extract_all(content, {rx}, {g + 1})" for g in range(n_groups))
        parts.append(
            f"SELECT * EXCLUDE (content), content, {lit(detector)} AS detector, {lit(rule_id)} AS rule_id, "
            f"{order} AS rule_ord, regexp_extract_all(content, {rx}, 0) AS texts, "
            f"string_split_regex(content, {rx}) AS gaps, [{groups}]::VARCHAR[][] AS gs FROM files "
            f"WHERE regexp_matches(content, {rx})" + (extra if detector == "entropy" else "")
        )
    return (
        f"files AS ({files}), hit_files AS ({' UNION ALL '.join(parts)}), "
        "hit_rows AS (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM hit_files), "
        "hit_at AS (SELECT * EXCLUDE (texts, gaps, gs), texts[i] AS match_text, "
        "list_transform(gs, lambda g: g[i]) AS groups, "
        "(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + "
        "coalesce(list_sum(list_transform(texts[1:i-1], lambda t: length(t))), 0))::BIGINT AS match_start FROM hit_rows), "
        "m AS (SELECT * EXCLUDE (i), length(left(content, match_start)) - "
        "length(replace(left(content, match_start), chr(10), '')) + 1 AS line_number, "
        "length(list_last(string_split(left(content, match_start), chr(10)))) + 1 AS column_start, "
        "string_split(content, chr(10))[length(left(content, match_start)) - "
        "length(replace(left(content, match_start), chr(10), '')) + 1] AS line_text FROM hit_at)"
    )


SPLIT_VALUE = (
    f"coalesce({group('match_text', fv.JSON_VALUE)}, {group('match_text', fv.CONNECTION_PASSWORD)}, "
    f"{group('trim(match_text)', fv.ASSIGNMENT, 2)}, "
    f"list_filter(groups, lambda g: g <> '' AND NOT {hit('g', fv.IDENTIFIER, '')})[1])"
)
SPLIT_NAME = case(
    [
        (f"{group('match_text', fv.JSON_VALUE)} IS NOT NULL", f"upper({group('match_text', fv.JSON_KEY)})"),
        (f"{group('match_text', fv.CONNECTION_PASSWORD)} IS NOT NULL", "'DB_PASSWORD'"),
        (f"{group('trim(match_text)', fv.ASSIGNMENT, 2)} IS NOT NULL", f"upper({group('trim(match_text)', fv.ASSIGNMENT)})"),
    ],
    f"upper(list_filter(groups, lambda g: g <> '' AND {hit('g', fv.IDENTIFIER, '')})[1])",
)
_FAST_PAIR = group("match_text", fv.FAST_JSON_PAIR, 2)
_FAST_BROKEN = group("match_text", fv.FAST_BROKEN_JSON, 2)
_FAST_ASSIGN = group("trim(match_text)", fv.ASSIGNMENT, 2)
SPLIT_VALUE_FAST = (
    f"coalesce({_FAST_PAIR}, {_FAST_BROKEN}, {_FAST_ASSIGN}, "
    "list_filter(groups, lambda g: length(g) > 10)[1], trim(trim(match_text), '\"'''))"
)
SPLIT_NAME_FAST = case(
    [
        (f"{_FAST_PAIR} IS NOT NULL", f"replace(replace(upper({group('match_text', fv.FAST_JSON_PAIR)}), ' ', '_'), '-', '_')"),
        (f"{_FAST_BROKEN} IS NOT NULL", f"upper({group('match_text', fv.FAST_BROKEN_JSON)})"),
        (f"{_FAST_ASSIGN} IS NOT NULL", f"upper({group('trim(match_text)', fv.ASSIGNMENT)})"),
    ]
)


def reason() -> str:
    """Families of the full profile over path, tested, value, actual_value, line_text."""
    low, v, line, tested = "lower(path)", "value", "line_text", "tested"
    printable = f"length(regexp_replace({v}, '[\\x20-\\x7e]', '', 'g'))"
    pairs = [
        (hit(low, fv.FP_PATHS), "noisy_file"),
        (f"{low} LIKE '%.html' AND {hit(v, fv.FP_HTML)}", "html_text"),
        (f"{low} LIKE '%.xml' AND ({hit(v, fv.FP_ANDROID)} OR {hit(line, fv.FP_ANDROID)})", "android_xml"),
        (hit(v, fv.FP_CSHARP), "csharp_code"),
        (f"{hit(v, fv.FP_PUBLIC_URL)} AND NOT {hit(v, fv.URL_CREDENTIAL_6)}", "public_url"),
        (hit(v, fv.FP_LOG), "log_template"),
        (f"({v} = {lit(fv.FP_ALPHABET_LITERAL)} OR {hit(v, fv.FP_ALPHABET, '')})", "alphabet"),
        (f"{printable} > length({v}) * 0.3", "unprintable"),
        (hit(v, fv.FP_MINIFIED, ""), "minified_js"),
        (hit(v, fv.FP_JS), "js_code"),
        (f"({hit(v, fv.FP_DATA_URI)} OR ({low} LIKE '%.css' AND {hit(v, fv.FP_CSS_BASE64, '')}))", "data_uri"),
        (hit(v, fv.FP_IDENTIFIER, ""), "identifier"),
        (hit(v, fv.FP_CSS), "css"),
        (
            f"{hit(v, fv.URL_TEMPLATE_START, '')} AND {hit(v, fv.URL_TEMPLATE_SLOT, '')} "
            f"AND NOT {hit(v, fv.URL_CREDENTIAL_1)}",
            "url_template",
        ),
        (hit(v, fv.FP_CODE), "code"),
        (hit(v, fv.FP_HEADERS), "http_header"),
        (f"{hit(v, 'https?://', '')} AND {hit(v, fv.FP_CDN)} AND NOT {hit(v, fv.URL_CREDENTIAL_8)}", "cdn_url"),
        (hit(v, fv.FP_UI_TEXT), "ui_text"),
        (hit(v, fv.FP_ANGULAR), "angular"),
        (hit(v, fv.FP_CALLS), "function_call"),
        (
            f"{hit(v, fv.ONE_WORD, '')} AND length({v}) < 30 AND NOT {hit(v, fv.CREDENTIAL_PREFIXES)} "
            f"AND {entropy(v)} < 3.5",
            "plain_word",
        ),
        (hit(tested, fv.FP_FORMAT), "format_template"),
        (hit(line, fv.FP_NAMESPACE), "xml_namespace"),
        (hit(line, fv.FP_ASSEMBLY), "assembly_reference"),
        (f"{hit('path', fv.TEST_PATH)} AND actual_value <> '' AND {entropy('actual_value')} < 3.0", "test_file"),
        (hit(v, fv.FP_PLACEHOLDER), "placeholder"),
        (f"length({v}) < 4", "too_short"),
        (hit(tested, fv.FP_DOC_DOMAINS), "doc_domain"),
    ]
    return case((c, lit(n)) for c, n in pairs)


def reason_fast() -> str:
    low, v, line = "lower(path)", "value", "line_text"
    pairs = [
        (f"length({v}) < 4", "too_short"),
        (hit(low, fv.FAST_SKIP_PATH), "noisy_file"),
        (f"{low} LIKE '%.xml' AND ({hit(v, fv.FP_ANDROID)} OR {hit(line, fv.FP_ANDROID)})", "android_xml"),
        (f"{low} LIKE '%.html' AND {hit(v, fv.FAST_HTML + fv.FAST_ANGULAR)}", "html_text"),
        (f"({low} LIKE '%.ts' OR {low} LIKE '%.js') AND ({hit(v, fv.FAST_JS)} OR {hit(v, fv.FAST_MINIFIED)})", "js_code"),
        (hit(v, fv.FAST_CSS), "css"),
        (hit(v, fv.FAST_CODE), "code"),
        (hit(v, fv.FAST_PLACEHOLDER), "placeholder"),
        (hit(v, fv.FAST_ANGULAR), "angular"),
        (hit(v, fv.FP_ANDROID), "android"),
        (contains_any(v, fv.FAST_LITERALS), "test_data"),
    ]
    return case((c, lit(n)) for c, n in pairs)


def _class_case(field: int) -> str:
    pairs = [
        (hit(where, p), ["'critical'", lit(kind), lit(wording)][field])
        for where in ("value", "line_text")
        for p, kind, wording in fv.ENTROPY_CRITICAL
    ]
    pairs += [
        (hit("lower(line_text)", p, ""), ["'high'", lit(kind), lit(wording)][field])
        for p, kind, wording in fv.ENTROPY_HIGH
    ]
    generic = ["'high'", "'generic_secret'", "'High entropy string'"]
    pairs.append(("entropy > 5.5 AND length(value) > 50", generic[field]))
    return case(pairs, ["'medium'", "'generic_secret'", "'High entropy string'"][field])


def judged(
    files: str, rules: list[Rule], profile: str = "full", entropy_on: bool = False, min_entropy: float = fv.MIN_ENTROPY
) -> str:
    """CTE chain ending in ``j``: the columns of a judged match."""
    fast = profile == "fast"
    value, name = (SPLIT_VALUE_FAST, SPLIT_NAME_FAST) if fast else (SPLIT_VALUE, SPLIT_NAME)
    candidate = "match_text" if fast else "groups[1]"
    excluded = f"NOT ({hit('value', fv.ENTROPY_VALUE_SKIP)} OR {hit('value', fv.ENTROPY_VALUE_SKIP_CASED, '')})"
    extra = "length(line_text) <= 500" if fast else excluded
    digest = "left(sha256(value), 16)" if fast else "sha256(value)"
    of_rule = lambda attr: lookup("rule_id", {r.rule_id: getattr(r, attr) for r in rules}) if rules else "NULL"
    if fast:
        sev, kind, desc = "'medium'", "'generic_secret'", "''"
    else:
        sev, kind = _class_case(0), _class_case(1)
        desc = f"({_class_case(2)}) || ' detected (entropy: ' || printf('%.2f', entropy) || ')'"
    if fast:
        suggest = f"'APP_' || CASE WHEN upper({STEM}) IN {in_list([*fv.FAST_GENERIC_STEMS, ''])} THEN '' ELSE upper({STEM}) || '_' END || upper(secret_type)"
    else:
        suggest = f"'APP_' || CASE WHEN upper({STEM}) IN {in_list([*fv.ENV_GENERIC_STEMS, ''])} THEN '' ELSE upper({STEM}) || '_' END || {lookup('secret_type', fv.ENV_BY_TYPE, lit('SECRET'))}"
    return (
        matches(files, rules, (profile if entropy_on else None))
        + f", s1 AS (SELECT *, CASE WHEN detector = 'rule' THEN {value} ELSE {candidate} END AS actual_value, "
        f"CASE WHEN detector = 'rule' THEN {name} END AS variable_name FROM m), "
        "s2 AS (SELECT *, coalesce(nullif(actual_value, ''), match_text) AS value FROM s1), "
        f"s3 AS (SELECT *, {entropy('value')} AS entropy, CASE WHEN detector = 'rule' THEN match_text ELSE value END AS tested FROM s2), "
        f"s4 AS (SELECT * FROM s3 WHERE detector = 'rule' OR (length(value) >= 20 AND entropy >= {min_entropy} AND {extra})), "
        f"s5 AS (SELECT *, {reason_fast() if fast else reason()} AS fp_reason, {digest} AS value_hash, "
        f"CASE WHEN detector = 'rule' THEN {of_rule('secret_type')} ELSE {kind} END AS secret_type, "
        f"CASE WHEN detector = 'rule' THEN {of_rule('severity')} ELSE {sev} END AS severity, "
        f"CASE WHEN detector = 'rule' THEN {of_rule('description')} ELSE {desc} END AS description FROM s4), "
        f"j AS (SELECT *, CASE WHEN detector = 'rule' THEN coalesce(variable_name, {suggest}) "
        f"{'ELSE ' + suggest if fast else ''} END AS suggested_variable, "
        + ("value AS exposed_value FROM s5)" if fast else "tested AS exposed_value FROM s5)")
    )


def findings(*args, **kw) -> str:
    """CTE chain ending in ``f``: matches that no family suppressed."""
    return judged(*args, **kw) + ", f AS (SELECT * FROM j WHERE fp_reason IS NULL)"


TYPE_CATEGORY = case(
    [
        ("contains(lower(secret_type), 'sql') AND contains(lower(secret_type), 'azure')", "'azure_sql'"),
        ("contains(lower(secret_type), 'sql')", "'sql_server'"),
        (contains_any("lower(secret_type)", ["rabbit", "amqp"]), "'rabbitmq'"),
        (contains_any("lower(secret_type)", ["fcm", "firebase"]), "'fcm'"),
        ("contains(lower(secret_type), 'jwt')", "'jwt'"),
        ("contains(lower(secret_type), 'vapid')", "'vapid'"),
        ("contains(lower(secret_type), 'api') AND contains(lower(secret_type), 'key')", "'api_key'"),
        ("contains(lower(secret_type), 'aws') AND contains(lower(secret_type), 'access')", "'aws_access_key'"),
        ("contains(lower(secret_type), 'aws')", "'aws_secret_key'"),
    ],
    "secret_type",
)
CONTENT_CATEGORY = case(
    [
        ("contains(lower(context), 'azure') OR contains(lower(exposed_value), 'database.windows.net')", "'azure_sql'"),
        (contains_any("secret_type", ["sql", "database", "connection"]), "'sql_server'"),
        ("contains(secret_type, 'rabbitmq') OR contains(lower(exposed_value), 'amqp://')", "'rabbitmq'"),
        ("contains(secret_type, 'fcm') OR contains(lower(exposed_value), 'firebase')", "'fcm'"),
        ("contains(secret_type, 'jwt') OR contains(replace(lower(context), ' ', ''), 'secretkey')", "'jwt'"),
        ("contains(secret_type, 'vapid') OR contains(lower(context), 'vapid')", "'vapid'"),
        ("contains(secret_type, 'ldap') OR contains(lower(context), 'ldap')", "'ldap'"),
        (hit("lower(exposed_value)", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", ""), "'internal_ip'"),
        ("contains(secret_type, 'api') AND contains(secret_type, 'key')", "'api_key'"),
    ],
    "secret_type",
)
CONTEXT = (
    "array_to_string(list_transform(range(greatest(1, line_number - 2), "
    "least(len(string_split(content, chr(10))), line_number + 2) + 1), "
    "lambda n: CASE WHEN n = line_number THEN '>>> ' ELSE '    ' END || lpad(n::VARCHAR, 4, ' ') || ' | ' || "
    "string_split(content, chr(10))[n]), chr(10))"
)


def shape(v: str) -> str:
    prefix = case(((f"starts_with({v}, {lit(p)})", lit(p)) for p in fv.SHAPE_PREFIXES), "''")
    rest = f"substr({v}, length({prefix}) + 1)"
    n = f"length({rest})"
    letters = f"({n} - length(regexp_replace({rest}, '\\pL', '', 'g')))"
    digits = f"({n} - length(regexp_replace({rest}, '\\p{{Nd}}', '', 'g')))"
    kind = case([(f"{letters} > 0 AND {digits} > 0", "'alnum'"), (f"{letters} > 0", "'alpha'"), (f"{digits} > 0", "'digit'")], "'mixed'")
    special = f"({n} - {letters} - {digits})"
    return (
        f"{prefix} || CASE WHEN {n} > 0 THEN '[' || {kind} || ':' || {n} || ']' || "
        f"CASE WHEN {special} > 0 THEN '+[special:' || {special} || ']' ELSE '' END ELSE '' END"
    )


def mask(v: str, style: str) -> str:
    n = f"length({v})"
    stars = lambda k: f"left({v}, {k}) || repeat('*', greatest(0, {n} - {2 * k})) || right({v}, {k})"
    ends = lambda a, mid, b: f"left({v}, {a}) || '{mid}' || right({v}, {b})"
    return {
        "keep_length": f"CASE WHEN {n} <= 8 THEN repeat('*', {n}) ELSE {stars(4)} END",
        "report": f"CASE WHEN coalesce({v}, '') = '' THEN '****' WHEN {n} <= 8 THEN left({v}, 2) || '****' ELSE {ends(8, '...', 4)} END",
        "summary": f"CASE WHEN {n} <= 16 THEN left({v}, 4) || '****' ELSE {ends(8, '...', 4)} END",
        "job": f"CASE WHEN {n} <= 9 THEN '***' ELSE {ends(3, '...', 3)} END",
        "task": f"CASE WHEN {n} > 10 THEN {ends(3, '...', 3)} ELSE '***' END",
        "wide": f"CASE WHEN {n} > 40 THEN {ends(10, '...', 10)} WHEN {n} > 10 THEN {stars(5)} ELSE '***' END",
        "short": f"CASE WHEN {n} > 10 THEN {ends(4, '****', 4)} ELSE '****' END",
    }[style]


FILE_CLASS = case(
    [
        (f"lower({BASE}) IN {in_list(fv.CONFIG_NAMES)} OR lower({SUFFIX}) IN {in_list(fv.CONFIG_EXTENSIONS)}", "'config'"),
        (f"lower({SUFFIX}) = '.xml' AND contains(lower(path), 'android')", "'android_xml'"),
        (f"lower({SUFFIX}) IN ('.kt', '.java') AND contains(lower(path), 'android')", "'android_code'"),
        (f"lower({BASE}) IN ('build.gradle', 'build.gradle.kts')", "'gradle'"),
        (f"lower({SUFFIX}) = '.plist'", "'ios_plist'"),
        (f"lower({SUFFIX}) = '.swift'", "'swift'"),
        (f"lower({SUFFIX}) IN ('.js', '.ts', '.jsx', '.tsx')", "'javascript'"),
        (f"lower({SUFFIX}) = '.py'", "'python'"),
        (f"contains(path, 'github/workflows') OR {contains_any(f'lower({BASE})', ['gitlab-ci', 'jenkinsfile'])}", "'cicd'"),
        (f"contains(lower({BASE}), 'dockerfile') OR lower({BASE}) = 'docker-compose.yml'", "'docker'"),
    ],
    "'other'",
)
LANGUAGE = f"coalesce({lookup(BASE, fv.LANGUAGE_BY_NAME)}, {lookup(f'lower({SUFFIX})', fv.LANGUAGE_BY_EXTENSION)}, 'unknown')"
HISTORY_SKIPPED = (
    f"(lower({SUFFIX}) IN {in_list(fv.HISTORY_SKIP_EXTENSIONS)} OR {BASE} IN {in_list(fv.HISTORY_SKIP_NAMES)} "
    f"OR len(list_filter(string_split(path, '/'), lambda p: p IN {in_list(fv.HISTORY_SKIP_DIRS)})) > 0)"
)
