"""False-positive suppression.

Each family is one named boolean over (path, value, whole match, line).  ``fp_reason`` is the
first family that fires, so a user can audit why a match was dropped.  Patterns of a family are
one literal alternation, compiled once per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import text
from leakframe.functions.regex import contains_any, has_mark, hits, line_hits, needs_mark
from leakframe.operators.rules import ScanConfig, usable


def _on(value: Column, bare: bool):
    """``hits`` on the value.  For a bare value, one without marks, patterns that need one are left out."""

    def found(patterns: list[str] | str, ignore_case: bool = True) -> Column:
        patterns = [patterns] if isinstance(patterns, str) else patterns
        left = [p for p in patterns if not (bare and needs_mark(p))]
        return hits(value, left, ignore_case) if left else F.lit(False)

    return found


def _value(matched: Column, actual: Column) -> Column:
    return F.coalesce(F.when(actual != "", actual), matched)


def families(
    path: Column, matched: Column, actual: Column, line: Column, config: ScanConfig, bare: bool = False
) -> list[tuple[str, Column]]:
    """Families of the full profile in the order they are tested; ``bare``: for values without marks."""
    value = _value(matched, actual)
    found = _on(value, bare)
    low_path = F.lower(path)
    out: list[tuple[str, Column]] = []

    def add(name: str, cond: Column) -> None:
        out.append((name, cond))

    add("noisy_file", line_hits(low_path, fv.FP_PATHS))
    add("html_text", low_path.endswith(".html") & found(fv.FP_HTML))
    add(
        "android_xml",
        low_path.endswith(".xml") & (found(fv.FP_ANDROID) | line_hits(line, fv.FP_ANDROID)),
    )
    add("csharp_code", found(fv.FP_CSHARP))
    add("public_url", found(fv.FP_PUBLIC_URL) & ~found(fv.URL_CREDENTIAL_6))
    add("log_template", found(fv.FP_LOG))
    add(
        "alphabet",
        (value == fv.FP_ALPHABET_LITERAL) | found(fv.FP_ALPHABET, ignore_case=False),
    )
    unprintable = F.length(F.regexp_replace(value, r"[\x20-\x7e]", ""))
    add("unprintable", F.rlike(value, F.lit(r"[^\x20-\x7e]")) & (unprintable > F.length(value) * F.lit(fv.UNPRINTABLE_SHARE)))
    add("minified_js", found(fv.FP_MINIFIED, ignore_case=False))
    add("js_code", found(fv.FP_JS))
    add(
        "data_uri",
        found(fv.FP_DATA_URI)
        | (low_path.endswith(".css") & found(fv.FP_CSS_BASE64, ignore_case=False)),
    )
    add("identifier", found(fv.FP_IDENTIFIER, ignore_case=False))
    add("css", found(fv.FP_CSS))
    add(
        "url_template",
        found(fv.URL_TEMPLATE_START, ignore_case=False)
        & found(fv.URL_TEMPLATE_SLOT, ignore_case=False)
        & ~found(fv.URL_CREDENTIAL_1),
    )
    add("code", found(fv.FP_CODE))
    add("http_header", found(fv.FP_HEADERS))
    add(
        "cdn_url",
        found("https?://", ignore_case=False)
        & found(fv.FP_CDN)
        & ~found(fv.URL_CREDENTIAL_8),
    )
    add("ui_text", found(fv.FP_UI_TEXT))
    add("angular", found(fv.FP_ANGULAR))
    add("function_call", found(fv.FP_CALLS))
    add(
        "plain_word",
        found(fv.ONE_WORD, ignore_case=False)
        & (F.length(value) < fv.ONE_WORD_MAX)
        & ~found(fv.CREDENTIAL_PREFIXES)
        & (text.entropy(value) < fv.ONE_WORD_ENTROPY),
    )
    catalog = usable(config.false_positive_patterns)
    if catalog:
        add("catalog_pattern", found(catalog))
    if config.public_tokens:
        add("public_token", contains_any(F.lower(value), [t.lower() for t in config.public_tokens]))
    for category, patterns in config.exclusions.items():
        patterns = usable(patterns)
        if patterns:
            add(f"exclusion_{category}", hits(matched, patterns) | line_hits(line, patterns))
    add("format_template", hits(matched, fv.FP_FORMAT))
    add("xml_namespace", line_hits(line, fv.FP_NAMESPACE))
    add("assembly_reference", line_hits(line, fv.FP_ASSEMBLY))
    add(
        "test_file",
        hits(path, fv.TEST_PATH)
        & F.coalesce(actual != "", F.lit(False))
        & (text.entropy(actual) < fv.TEST_ENTROPY),
    )
    add("placeholder", found(fv.FP_PLACEHOLDER))
    add("too_short", F.length(value) < 4)
    domains = fv.FP_DOC_DOMAINS
    if config.strict_doc_domains:
        domains = [d if "*" in d else d.replace(".", r"\.") for d in domains]
    add("doc_domain", line_hits(matched, domains))
    return out


def fast_families(
    path: Column, matched: Column, actual: Column, line: Column, config: ScanConfig, bare: bool = False
) -> list[tuple[str, Column]]:
    """Families of the fast profile, cheap tests first; ``bare``: for values without marks."""
    value = _value(matched, actual)
    found = _on(value, bare)
    low_path = F.lower(path)
    script = low_path.endswith(".ts") | low_path.endswith(".js")
    return [
        ("too_short", F.length(value) < 4),
        ("noisy_file", line_hits(low_path, fv.FAST_SKIP_PATH)),
        (
            "android_xml",
            low_path.endswith(".xml") & (found(fv.FP_ANDROID) | line_hits(line, fv.FP_ANDROID)),
        ),
        ("html_text", low_path.endswith(".html") & found(fv.FAST_HTML + fv.FAST_ANGULAR)),
        (
            "js_code",
            script & (found(fv.FAST_JS) | found(fv.FAST_MINIFIED)),
        ),
        ("css", found(fv.FAST_CSS)),
        ("code", found(fv.FAST_CODE)),
        ("placeholder", found(fv.FAST_PLACEHOLDER)),
        ("angular", found(fv.FAST_ANGULAR)),
        ("android", found(fv.FP_ANDROID)),
        ("test_data", contains_any(value, fv.FAST_LITERALS)),
    ]


def fp_reason(
    path: Column,
    matched: Column,
    actual: Column,
    line: Column,
    config: ScanConfig | None = None,
) -> Column:
    """Name of the first family that fires, NULL for a real finding.

    Most secrets are one bare word, and most patterns need punctuation: one search of the value
    tells whether they are tried."""
    config = config or ScanConfig()
    build = fast_families if config.profile == "fast" else families

    def first(bare: bool) -> Column:
        return text.first_hit((cond, name) for name, cond in build(path, matched, actual, line, config, bare))

    return F.when(has_mark(_value(matched, actual)), first(False)).otherwise(first(True))


def review_hints(value: Column, files_text: Column) -> Column:
    """Hints for a reviewer, ``; ``-joined, '' when there is none.

    ``files_text`` is the lowercased text of the list of files the value was found in.
    """
    low = F.lower(value)
    t = fv.HINT_TEXT
    bare = F.translate(value, "+/=", "")
    alnum = F.rlike(bare, F.lit(r"^[\p{L}\p{N}]+\z"))
    stripped = text.python_strip(value)
    starts = lambda col, items: F.rlike(
        col, F.lit("^(?:" + "|".join(r"\Q" + i + r"\E" for i in items) + ")")
    )
    tests = [
        (starts(value, ["sha256/", "sha1/"]), "pin"),
        (
            value.contains("=")
            & F.length(value).isin(fv.HINT_HASH_LENGTHS)
            & alnum
            & (low.contains("sha") | files_text.contains("certificate") | files_text.contains("pin")),
            "hash",
        ),
        (starts(low, ["http://", "https://"]) & contains_any(low, fv.HINT_DOC_URL), "doc_url"),
        (contains_any(low, ["schemas.android.com", "xmlns"]), "namespace"),
        (contains_any(low, ["android.support.", "androidx."]), "library"),
        (
            starts(low, ["com.", "org.", "net."]) & contains_any(value, ["host=", "package="]),
            "package",
        ),
        (contains_any(low, fv.HINT_CODE), "code"),
        (low.isin(fv.HINT_PLACEHOLDER), "placeholder"),
        (F.length(value) < 8, "short"),
        (starts(stripped, fv.HINT_COMMENT), "comment"),
        (contains_any(low, ["adapter", "instrumented", "test"]), "test_class"),
        (contains_any(low, ["file_provider", "fileprovider"]), "provider"),
    ]
    return F.concat_ws("; ", *[F.when(cond, F.lit(t[key])) for cond, key in tests])
