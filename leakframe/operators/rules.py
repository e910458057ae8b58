"""Rule catalog: validation and the options of a scan.

A scan takes its catalog as literals in the plan: rules, and an index from the literal text that a
match must hold to the rules.  A text finds its rules through the index, so that a rule whose
text is not there costs nothing.  ``checked`` judges a table of rules as a table, without the driver;
``from_table`` brings a catalog to the driver, which a scan needs.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import regex as rx


class RuleError(ValueError):
    """A rule that cannot be used."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    regex: str
    secret_type: str
    severity: str
    description: str = ""
    remediation: str = ""
    ord: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.regex, re.IGNORECASE | re.MULTILINE)


@dataclass(frozen=True)
class ScanConfig:
    """Options of one scan; the defaults are the reference behaviour."""

    file_includes: list[str] = field(default_factory=list)
    file_excludes: list[str] = field(default_factory=list)
    path_allowlist: list[str] = field(default_factory=list)
    false_positive_patterns: list[str] = field(default_factory=list)
    public_tokens: list[str] = field(default_factory=list)
    exclusions: dict[str, list[str]] = field(default_factory=dict)
    entropy_enabled: bool = True
    min_entropy: float = fv.MIN_ENTROPY
    min_length: int = fv.MIN_ENTROPY_LENGTH
    max_file_size: int = fv.MAX_FILE_SIZE
    strict_doc_domains: bool = False
    profile: str = "full"
    with_context: bool = True
    with_json: bool = False
    env_prefix: str = "APP_"


def usable(patterns: list[str]) -> list[str]:
    """Allowlist patterns that compile; the others are skipped, as a catalog loader does."""
    kept = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        kept.append(p)
    return kept


def check(rules: list[Rule]) -> list[Rule]:
    """Validate a catalog and return it in order.  A bad rule raises, an empty match is bad."""
    for rule in rules:
        problem = _problem(rule.regex, rule.severity)
        if problem:
            raise RuleError(f"rule {rule.name!r} {problem}")
    return sorted(rules, key=lambda r: r.ord)


def from_table(catalog: DataFrame) -> list[Rule]:
    """Read a rules DataFrame (schemas.RULES) as a validated catalog."""
    rows = catalog.collect()  # patterns are part of the plan
    return check(
        [
            Rule(r.rule_id, r.name, r.regex, r.secret_type, r.severity,
                 r.description or "", r.remediation or "", r.ord)
            for r in rows
        ]
    )


def java_pattern(rule: Rule) -> str:
    return rx.flags(multiline=True) + _java(rule.regex)


def _java(regex: str) -> str:
    """A digit that must follow a word boundary is asked for first: the boundary is dearer to test."""
    ahead = ""
    if regex.startswith(r"\b\d"):
        first = list(re._parser.parse(regex, re.IGNORECASE | re.MULTILINE))[1:2]
        # a branch or an optional digit does not stand there as such
        if first and (str(first[0][0]) == "IN" or (str(first[0][0]) == "MAX_REPEAT" and first[0][1][0] > 0)):
            ahead = rx.to_java(r"(?=\d)")
    return ahead + rx.to_java(regex)


def required_literal(rule: Rule) -> str | None:
    """Longest lowercase ASCII run that every match must contain, or None.

    It feeds a plain substring test that runs before the regex.
    """
    runs = rx.required_runs(re._parser.parse(rule.regex, re.IGNORECASE | re.MULTILINE))
    return max(runs, key=len, default=None)


ANCHOR = 4  # characters; an anchor is found by one search for all of them


@dataclass(frozen=True)
class Index:
    """Rule numbers ``by_anchor``; those without one that are found by an alternation (``loose``),
    and those that no cheap test covers (``always``)."""

    by_anchor: dict[str, list[int]]
    loose: list[int]
    always: list[int]

    def size(self) -> int:
        """Buckets of the lookup table: a power of two."""
        return 1 << (2 * len(self.by_anchor)).bit_length()

    def buckets(self) -> list[list[int]]:
        """By the checksum of an anchor.  Two anchors of one bucket only add rules to try."""
        table: list[list[int]] = [[] for _ in range(self.size())]
        for anchor, found in self.by_anchor.items():
            table[zlib.crc32(anchor.encode()) % len(table)] += found
        return table

    def search(self) -> str:
        """A regex whose group 1 is the anchor at a place, at every place that has one.  Anchors
        are of one length, so none hides another; shared beginnings are tested once."""

        def branch(anchors: list[str]) -> str:
            if len(anchors) == 1:
                return rx.escape_literal(anchors[0])
            firsts = sorted({a[0] for a in anchors})
            return "(?:" + "|".join(rx.escape_literal(c) + branch([a[1:] for a in anchors if a[0] == c]) for c in firsts) + ")"

        first = "".join(rx.escape_literal(c) for c in sorted({a[0] for a in self.by_anchor}))
        return f"(?=[{first}])(?=({branch(sorted(self.by_anchor))}))"


def index(rules: list[Rule]) -> Index:
    """Each rule by the part of its required literal that the fewest rules have so far."""
    by_anchor: dict[str, list[int]] = {}
    loose, always = [], []
    for number, rule in enumerate(rules):
        literal = required_literal(rule) or ""
        parts = [literal[i:i + ANCHOR] for i in range(len(literal) - ANCHOR + 1)]
        if parts:
            by_anchor.setdefault(min(parts, key=lambda p: len(by_anchor.get(p, ()))), []).append(number)
        elif _REFERS.search(rule.regex):
            always.append(number)  # numbered groups would shift in an alternation
        else:
            loose.append(number)
    return Index(by_anchor, loose, always)


_REFERS = re.compile(r"\\[1-9]|\(\?P=|\(\?\(")


def any_rule(rules: list[Rule], numbers: list[int]) -> str:
    """One Java pattern that finds what any of these rules finds."""
    parts = [re.sub(r"\(\?<[A-Za-z]\w*>", "(", _java(rules[i].regex)) for i in numbers]
    return rx.flags(multiline=True) + "|".join(f"(?:{p})" for p in parts)


def checked(catalog: DataFrame) -> DataFrame:
    """A rules table (schemas.RULES) with ``problem``: why ``check`` would refuse the rule, null if it
    would not.  Rules stay where they are."""

    @F.arrow_udf("string")
    def refused(regex: pa.Array, severity: pa.Array) -> pa.Array:
        return pa.array([_problem(r, s) for r, s in zip(regex.to_pylist(), severity.to_pylist())], pa.string())

    return catalog.withColumn("problem", refused("regex", "severity"))


def _problem(regex: str | None, severity: str | None) -> str | None:
    try:
        compiled = re.compile(regex or "", re.IGNORECASE | re.MULTILINE)
    except re.error as err:
        return f"does not compile: {err}"
    if compiled.search("") is not None:
        return "matches the empty string"
    return None if severity in fv.SEVERITIES else f"has unknown severity {severity!r}"


# A small pack of our own; users bring their catalog as a table.
STARTER_RULES = [
    Rule("aws_access_key", "AWS Access Key", r"AKIA[A-Z0-9]{16}", "aws_access_key", "critical",
         "AWS access key id", "Rotate the key and load it from the environment", 1),
    Rule("github_token", "GitHub Token", r"ghp_[a-zA-Z0-9]{36}", "github_token", "critical",
         "GitHub personal access token", "Revoke the token", 2),
    Rule("generic_api_key", "Generic API Key", r"sk_live_[a-zA-Z0-9]{20,}", "api_key", "high",
         "Live API key", "Rotate the key", 3),
    Rule("private_key", "Private Key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[^-]+-----END",
         "private_key", "critical", "Private key block", "Replace the key pair", 4),
    Rule("db_password", "Database Password", r'password\s*=\s*[^;"\s]{4,}', "database_password",
         "critical", "Password in a connection string", "Use a secret store", 5),
    Rule("auth_token", "Auth Token", r'\btoken\s*=\s*"([^"]+)"', "auth_token", "high",
         "Token in an assignment", "Load the token from the environment", 6),
    Rule("ip_address", "IP Address", r"\b\d{1,3}(\.\d{1,3}){3}\b", "ip_address", "low",
         "Address of a host", "Use a host name", 7),
]
