"""Detection: rule matches and high-entropy candidates, in one pass over the text.

Per row, an index of the catalog names the rules that may match, and each that does adds a
struct with its match texts and the gaps between them, from built-in regex functions.  Gap and
match lengths give exact positions.  Only matched rows pay for that, and ``content`` is dropped at
the explode, so no text goes through a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import masks, names, text
from leakframe.functions.regex import any_of, contains_any, flags, group, hits, let, to_java
from leakframe.operators import rules as rule_ops
from leakframe.operators.rules import Rule, ScanConfig
from leakframe.operators.suppress import fp_reason
from leakframe.session import built_once

_BLOCK = 256  # matches are numbered in blocks, so that appending stays cheap for any count

_SPOT = "struct<line:int,col:int,at:int>"
_STATE = f"struct<line:int,col:int,at:int,done:array<array<{_SPOT}>>,block:array<{_SPOT}>>"
MATCH_FIELDS = (
    "detector string, rule_id string, rule_ord int, line_number int, column_start int, "
    "match_start int, match_text string, groups array<string>, line_text string, context string"
)


def _tail(piece: Column) -> Column:
    return F.length(F.substring_index(piece, "\n", -1))


def positions(gaps: Column, texts: Column) -> Column:
    """Line (from 1), column (from 1) and offset (from 0) of every match, in order.

    The state walks gap by gap.  It fills blocks of matches and keeps finished blocks in a
    short outer array, so the cost stays close to linear in the number of matches.
    """
    pieces = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(texts)),
        texts,
        lambda g, t: F.struct(
            text.newlines(g).alias("gl"), _tail(g).alias("gt"), F.length(g).alias("gn"),
            text.newlines(t).alias("tl"), _tail(t).alias("tt"), F.length(t).alias("tn"),
        ),
    )

    def step(s: Column, p: Column) -> Column:
        line = s.line + p.gl
        col = F.when(p.gl > 0, p.gt).otherwise(s.col + p.gt)
        at = s.at + p.gn
        spot = F.struct(line.alias("line"), (col + 1).alias("col"), at.alias("at"))
        return F.struct(
            (line + p.tl).alias("line"),
            F.when(p.tl > 0, p.tt).otherwise(col + p.tt).alias("col"),
            (at + p.tn).alias("at"),
            s.done.alias("done"),
            F.concat(s.block, F.array(spot)).alias("block"),
        )

    def close(s: Column) -> Column:
        return F.struct(
            s.line, s.col, s.at,
            F.concat(s.done, F.array(s.block)).alias("done"),
            F.array().cast(f"array<{_SPOT}>").alias("block"),
        )

    zero = F.struct(
        F.lit(1).alias("line"), F.lit(0).alias("col"), F.lit(0).alias("at"),
        F.array().cast(f"array<array<{_SPOT}>>").alias("done"),
        F.array().cast(f"array<{_SPOT}>").alias("block"),
    ).cast(_STATE)

    def walk(ps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ps)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(ps, i, F.lit(_BLOCK)))
        return F.flatten(
            F.aggregate(blocks, zero, lambda s, b: F.aggregate(b, s, step, close), lambda s: s.done)
        )

    return let(pieces, walk)


def _hit_struct(
    detector: str, rule_id: str, order: int, content: Column, pattern: Column, n_groups: int, cond: Column
) -> Column:
    groups = (
        F.array(*[F.regexp_extract_all(content, pattern, F.lit(g + 1)) for g in range(n_groups)])
        if n_groups
        else F.array().cast("array<array<string>>")
    )
    return F.when(
        cond,
        F.struct(
            F.lit(detector).alias("detector"),
            F.lit(rule_id).alias("rule_id"),
            F.lit(order).alias("rule_ord"),
            F.regexp_extract_all(content, pattern, F.lit(0)).alias("texts"),
            F.split(content, pattern, -1).alias("gaps"),
            groups.alias("groups"),
        ),
    )


def _entropy_hits(content: Column, path: Column, config: ScanConfig, order: int) -> Column:
    """The candidate pattern of the entropy operator, as one more rule.

    A candidate never spans lines, so finding it in the whole text equals finding it per line.
    """
    if config.profile == "fast":
        pattern = F.lit(flags(ignore_case=False) + fv.BARE_CANDIDATE)
        return _hit_struct("entropy", "entropy", order, content, pattern, 0, F.rlike(content, pattern))
    pattern = F.lit(flags(ignore_case=False) + fv.QUOTED_CANDIDATE)
    wanted = ~entropy_path_skipped(path)
    return _hit_struct(
        "entropy", "entropy", order, content, pattern, 1, wanted & F.rlike(content, pattern)
    )


def entropy_path_skipped(path: Column) -> Column:
    """Project, config, lock, minified and script files take no part in the entropy operator."""
    low = F.lower(path)
    return contains_any(low, fv.ENTROPY_PATH_SKIP) | low.endswith(".js")


def _expand(content: Column, all_hits: Column, config: ScanConfig) -> Column:
    """Array of match structs of one text: position, groups, line, context."""
    window = text.bare_context if config.profile == "fast" else text.context_window

    def per_rule(h: Column) -> Column:
        return let(
            positions(h.gaps, h.texts),
            lambda spots: F.transform(
                h.texts,
                lambda t, i: F.struct(
                    h.detector, h.rule_id, h.rule_ord,
                    F.element_at(spots, i + 1).line.alias("line_number"),
                    F.element_at(spots, i + 1).col.alias("column_start"),
                    F.element_at(spots, i + 1)["at"].alias("match_start"),
                    t.alias("match_text"),
                    F.transform(h.groups, lambda g: F.element_at(g, i + 1)).alias("groups"),
                ),
            ),
        )

    def json_fields(lines: Column, sections: Column | None, m: Column) -> list[Column]:
        if sections is None:
            return []
        split = (split_match_fast if config.profile == "fast" else split_match)(m.match_text, m.groups)
        candidate = m.match_text if config.profile == "fast" else F.get(m.groups, F.lit(0))
        value = F.when(m.detector == "rule", F.coalesce(split.actual_value, m.match_text)).otherwise(candidate)
        at = let(value, lambda v: text.json_location(content, lines, sections, v))
        return [at.json_section.alias("json_section"), at.json_key.alias("json_key")]

    def with_lines(hs: Column) -> Column:
        def described(lines: Column, sections: Column | None) -> Column:
            return F.transform(
                F.flatten(F.transform(hs, per_rule)),
                lambda m: F.struct(
                    m.detector, m.rule_id, m.rule_ord, m.line_number, m.column_start,
                    m.match_start, m.match_text, m.groups,
                    F.element_at(lines, m.line_number).alias("line_text"),
                    (window(lines, m.line_number) if config.with_context else F.lit(None).cast("string"))
                    .alias("context"),
                    *json_fields(lines, sections, m),
                ),
            )

        def located(lines: Column) -> Column:
            return let(text.json_sections(lines), lambda sections: described(lines, sections)) if config.with_json else described(lines, None)

        return let(F.split(content, "\n", -1), located)

    return F.when(F.size(all_hits) > 0, with_lines(all_hits))


def find_matches(
    files: DataFrame,
    rules: list[Rule],
    config: ScanConfig | None = None,
    content: str = "content",
) -> DataFrame:
    """Every non-overlapping match of every rule (and entropy candidate) with its position.

    Keeps all columns of ``files`` but the text.  One narrow stage, no shuffle.
    """
    config = config or ScanConfig()
    rules = rule_ops.check(rules)
    body = F.col(content)
    keys = [c for c in files.columns if c != content]
    low, odd = F.lower(body), contains_any(body, ["ſ", "ı", "İ"])
    staged = files.where(body.isNotNull()).select(
        *keys, body.alias("_text"), low.alias("_low"), odd.alias("_odd")
    )
    t = F.col("_text")
    if not rules and not config.entropy_enabled:
        raise ValueError("nothing to detect: no rules and entropy is off")
    found = []
    if rules:
        found.append(_catalog_hits(t, rules, F.col("_low"), F.col("_odd")))
    if config.entropy_enabled:
        last = max((r.ord for r in rules), default=0) + 1
        found.append(F.array_compact(F.array(_entropy_hits(t, F.col("path"), config, last))))
    found = F.concat(*found)
    hit = staged.select(*keys, "_text", found.alias("_hits"))
    expand = lambda: {"_m": F.explode(_expand(t, F.col("_hits"), config)).alias("_m")}
    matches = built_once(f"expand {config!r}", expand)
    return hit.select(*keys, matches["_m"]).select(*keys, "_m.*")


_ALONE = 8  # rules with a short literal that run without an alternation before them
_CATALOG = "array<struct<rule_id:string,ord:int,pattern:string,literal:string,groups:int>>"


def _catalog_hits(content: Column, rules: list[Rule], low: Column, odd: Column) -> Column:
    """Array of the hits of all rules, in the order of the catalog.

    Catalog and index are folded literals, so the plan does not grow with them.  One search finds
    the anchors that the text holds, each anchor names its rules by a table lookup, and only those
    rules run: the cost follows the text and its hits, not the number of rules.  Rules without an
    anchor share one alternation, and run where that is found; a few with a short literal run where
    the text holds it."""
    rows = [
        {"rule_id": r.rule_id, "ord": r.ord, "pattern": rule_ops.java_pattern(r), "literal": rule_ops.required_literal(r), "groups": r.compiled().groups}
        for r in rules
    ]
    catalog = F.from_json(F.lit(json.dumps(rows)), _CATALOG)
    index = rule_ops.index(rules)
    numbers = lambda found: F.from_json(F.lit(json.dumps(found)), "array<int>")
    named = [numbers(index.always)]
    if index.by_anchor:
        table = F.from_json(F.lit(json.dumps(index.buckets())), "array<array<int>>")
        bucket = lambda anchor: F.get(table, F.pmod(F.crc32(anchor.cast("binary")), F.lit(index.size())).cast("int"))
        anchors = F.regexp_extract_all(low, F.lit(index.search()), F.lit(1))
        named.append(F.flatten(F.transform(F.array_distinct(anchors), bucket)))
    # a rule with a short literal is tried where that stands: cheaper than its branch of an alternation
    short = [i for i in index.loose if rows[i]["literal"]]
    short = short if len(short) <= _ALONE else []
    loose = [i for i in index.loose if i not in short]
    if short:
        named.append(numbers(short))
    if loose:
        named.append(F.when(F.rlike(content, F.lit(rule_ops.any_rule(rules, loose))), numbers(loose)).otherwise(numbers([])))
    chosen = F.when(odd, numbers(list(range(len(rules))))).otherwise(F.array_sort(F.array_distinct(F.concat(*named))))
    may = lambda r: F.coalesce(F.contains(low, r["literal"]), F.lit(True)) | odd
    active = F.filter(F.transform(chosen, lambda i: F.get(catalog, i)), may)
    none = F.array().cast("array<array<string>>")
    found = F.filter(
        F.transform(active, lambda r: F.struct(r.alias("rule"), F.regexp_extract_all(content, r["pattern"], F.lit(0)).alias("texts"))),
        lambda f: F.size(f["texts"]) > 0,
    )

    def hit(f: Column) -> Column:
        r = f["rule"]
        groups = F.transform(F.sequence(F.lit(1), r["groups"]), lambda g: F.regexp_extract_all(content, r["pattern"], g))
        return F.struct(
            F.lit("rule").alias("detector"), r["rule_id"].alias("rule_id"), r["ord"].alias("rule_ord"),
            f["texts"].alias("texts"), F.split(content, r["pattern"], -1).alias("gaps"),
            F.when(r["groups"] > 0, groups).otherwise(none).alias("groups"),
        )

    return F.transform(found, hit)


def split_match(matched: Column, groups: Column) -> Column:
    """STRUCT(variable_name, actual_value) of a rule match, full profile."""
    value = group(matched, fv.JSON_VALUE)
    password = group(matched, fv.CONNECTION_PASSWORD)
    stripped = text.python_strip(matched)
    assigned = group(stripped, fv.ASSIGNMENT, 2)
    is_name = lambda g: hits(g, fv.IDENTIFIER, ignore_case=False)
    named = F.get(F.filter(groups, lambda g: (g != "") & is_name(g)), F.lit(0))
    other = F.get(F.filter(groups, lambda g: (g != "") & ~is_name(g)), F.lit(0))
    return F.struct(
        F.when(value.isNotNull(), F.upper(group(matched, fv.JSON_KEY)))
        .when(password.isNotNull(), F.lit("DB_PASSWORD"))
        .when(assigned.isNotNull(), F.upper(group(stripped, fv.ASSIGNMENT, 1)))
        .otherwise(F.upper(named))
        .alias("variable_name"),
        F.coalesce(value, password, assigned, other).alias("actual_value"),
    )


def split_match_fast(matched: Column, groups: Column) -> Column:
    """STRUCT(variable_name, actual_value) of a rule match, fast profile."""
    pair = group(matched, fv.FAST_JSON_PAIR, 2)
    broken = group(matched, fv.FAST_BROKEN_JSON, 2)
    stripped = text.python_strip(matched)
    assigned = group(stripped, fv.ASSIGNMENT, 2)
    long_group = F.get(F.filter(groups, lambda g: F.length(g) > 10), F.lit(0))
    return F.struct(
        F.when(pair.isNotNull(), F.translate(F.upper(group(matched, fv.FAST_JSON_PAIR)), " -", "__"))
        .when(broken.isNotNull(), F.upper(group(matched, fv.FAST_BROKEN_JSON)))
        .when(assigned.isNotNull(), F.upper(group(stripped, fv.ASSIGNMENT, 1)))
        .alias("variable_name"),
        F.coalesce(
            pair, broken, assigned, long_group, F.regexp_replace(stripped, "^[\"']+|[\"']+$", "")
        ).alias("actual_value"),
    )


def classify_entropy(value: Column, line: Column, bits: Column) -> Column:
    """STRUCT(severity, secret_type, description) of a high-entropy value."""
    low_line = F.lower(line)
    shown = F.format_string("%.2f", F.bround(bits, 2))

    def verdict(severity: str, kind: str, wording: str) -> Column:
        return F.expr(
            f"named_struct('severity', '{severity}', 'secret_type', '{kind}', 'wording', '{wording}')"
        )

    pairs = [
        (hits(where, p), verdict("critical", kind, wording))
        for where in (value, line)
        for p, kind, wording in fv.ENTROPY_CRITICAL
    ]
    pairs += [
        (hits(low_line, p, ignore_case=False), verdict("high", kind, wording))
        for p, kind, wording in fv.ENTROPY_HIGH
    ]
    generic = "High entropy string"
    pairs.append(
        ((bits > 5.5) & (F.length(value) > 50), verdict("high", "generic_secret", generic))
    )
    chosen = text.first_hit(pairs + [(F.lit(True), verdict("medium", "generic_secret", generic))])
    return let(
        chosen,
        lambda c: F.struct(
            c.severity.alias("severity"),
            c.secret_type.alias("secret_type"),
            F.concat(c.wording, F.lit(" detected (entropy: "), shown, F.lit(")")).alias("description"),
        ),
    )


_CLASS = "struct<severity:string,secret_type:string,description:string>"


def _entropy_class(config: ScanConfig, line: Column) -> Column:
    """Class of entropy rows, NULL for rule rows."""
    if not config.entropy_enabled:
        return F.lit(None).cast(_CLASS)
    if config.profile == "fast":
        given = F.expr("named_struct('severity', 'medium', 'secret_type', 'generic_secret', 'description', '')")
    else:
        given = classify_entropy(F.col("value"), line, F.col("entropy"))
    return F.when(F.col("detector") == "entropy", given)


def entropy_excluded(value: Column) -> Column:
    """Quoted values that are not looked at: SQL, URLs, paths, sentences, assembly references."""
    return hits(value, fv.ENTROPY_VALUE_SKIP) | F.rlike(
        value, F.lit(any_of(fv.ENTROPY_VALUE_SKIP_CASED, ignore_case=False))
    )


def _barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generator.

    A filter on these columns is not pushed below it, so expensive values are computed once
    per row instead of once in a filter and again in the output.
    """
    fresh = F.struct(*[c.alias(n) for n, c in cols.items()]).alias("_fresh")
    kept = [c for c in df.columns if c not in cols]
    # a projection is compiled, what stands inside a generator is interpreted
    return df.select(*kept, fresh).select(*kept, F.inline(F.array("_fresh")))


def judge(
    matches: DataFrame, rules: list[Rule], config: ScanConfig | None = None
) -> DataFrame:
    """Split, measure, classify and suppress matches: ``schemas.FINDINGS`` columns.

    Needs ``path``; so a text that sits at several paths can be matched once and judged per
    path.  Suppressed matches stay, with ``fp_reason`` set.
    """
    config = config or ScanConfig()
    c = built_once(f"judge {config!r}", lambda: _judge_columns(config))
    parted = _barrier(matches, _split=c["split"])
    valued = _barrier(parted, **{k: c[k] for k in ("variable_name", "actual_value", "value")}).drop("_split")
    # entropy and reason stand in a projection: the filters evaluate them where they ask for them
    kept = valued.withColumn("entropy", c["entropy"]).where(c["keep"])
    reasoned = _barrier(kept, _class=c["class"]).withColumn("fp_reason", c["fp_reason"])
    own = [F.col(x) for x in matches.columns if x not in _MATCH_COLUMNS]
    typed = _with_rule(reasoned, rules).withColumn("_type", c["type"])
    where = [F.col(x) for x in ("repo", "branch", "commit_hash") if x in matches.columns]
    identity = masks.sha256(F.concat_ws(":", *where, c["place"])).alias("finding_id")
    return typed.select(*own, *[identity if x == "finding_id" else c[x] for x in _OUTPUT])


_OUTPUT = [
    "out detector", "out rule_id", "out rule_ord", "out match_start", "out line_number",
    "column_start", "column_end", "secret_type", "severity", "exposed_value", "out_actual_value",
    "out value", "out variable_name", "value_hash", "out entropy", "suggested_variable",
    "out context", "description", "remediation", "false_positive", "out fp_reason", "finding_id",
]


def _judge_columns(config: ScanConfig) -> dict[str, Column]:
    """The columns of ``judge``, by name of their inputs."""
    fast = config.profile == "fast"
    matched, groups, line = F.col("match_text"), F.col("groups"), F.col("line_text")
    value, path = F.col("value"), F.col("path")
    is_rule = F.col("detector") == "rule"
    pair = "struct<variable_name:string,actual_value:string>"
    candidate = matched if fast else F.get(groups, F.lit(0))
    split = (split_match_fast if fast else split_match)(matched, groups)
    actual = F.col("_split.actual_value")
    tested = F.when(is_rule, matched).otherwise(value)

    start = F.col("column_start")
    first = F.when(is_rule, start).otherwise(F.lit(0) if fast else start - 1)
    last = first + F.length(matched)
    suggest = (names.env_name_fast if fast else names.env_name)(F.col("_type"), path, config.env_prefix)
    advice = "" if fast else "Review if this is a secret and use environment variables"
    digest = masks.value_hash(value, config.profile)
    place = F.concat_ws(":", path, F.col("line_number").cast("string"), first.cast("string"), "rule_id", digest)

    columns = {
        "split": F.when(is_rule, split).otherwise(
            F.struct(F.lit(None).cast("string"), candidate).cast(pair)
        ),
        "variable_name": F.col("_split.variable_name"),
        "actual_value": actual,
        "value": F.coalesce(F.when(actual != "", actual), matched),
        "keep": is_rule
        | (
            (F.length(value) >= config.min_length)
            & (F.col("entropy") >= config.min_entropy)
            & ((F.length(line) <= fv.FAST_MAX_LINE) if fast else ~entropy_excluded(value))
        ),
        "fp_reason": fp_reason(path, tested, F.col("actual_value"), line, config),
        "class": _entropy_class(config, line),
        "type": F.coalesce("_class.secret_type", "_rule_secret_type"),
        "column_start": first.alias("column_start"),
        "column_end": (F.when(is_rule, last).otherwise(F.lit(0)) if fast else last).alias("column_end"),
        "secret_type": F.col("_type").alias("secret_type"),
        "severity": F.coalesce("_class.severity", "_rule_severity").alias("severity"),
        "exposed_value": (value if fast else tested).alias("exposed_value"),
        "out_actual_value": F.when(is_rule, F.col("actual_value")).alias("actual_value"),
        "value_hash": digest.alias("value_hash"),
        "suggested_variable": F.when(is_rule, F.coalesce("variable_name", suggest))
        .otherwise(suggest if fast else F.lit(None))
        .alias("suggested_variable"),
        "description": F.coalesce("_class.description", "_rule_description").alias("description"),
        "remediation": F.when(is_rule, F.col("_rule_remediation")).otherwise(advice).alias("remediation"),
        "false_positive": F.col("fp_reason").isNotNull().alias("false_positive"),
        "place": place,
    }
    columns["entropy"] = text.entropy(value)
    columns |= {o: F.col(o[4:]) for o in _OUTPUT if o.startswith("out ")}
    return columns


def _with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the catalog columns of the rule.  The catalog is already part of the plan, so it goes
    to every task in any case."""
    rows = [(r.rule_id, r.secret_type, r.severity, r.description, r.remediation) for r in rules]
    names_of = ["secret_type", "severity", "description", "remediation"]
    schema = "rule_id string, " + ", ".join(f"_rule_{n} string" for n in names_of)
    catalog = df.sparkSession.createDataFrame(rows, schema)
    return df.join(F.broadcast(catalog), "rule_id", "left")


_MATCH_COLUMNS = [f.strip().split(" ")[0] for f in MATCH_FIELDS.split(", ")]


def scan(files: DataFrame, rules: list[Rule], config: ScanConfig | None = None) -> DataFrame:
    """All matches of a set of files with a verdict each; the text is read once."""
    config = config or ScanConfig()
    return judge(find_matches(files, rules, config), rules, config)


def findings(judged: DataFrame) -> DataFrame:
    """The public view: matches that no family suppressed."""
    kept = judged.where(F.col("fp_reason").isNull())
    known = {"fp_reason": F.lit(None).cast("string"), "false_positive": F.lit(False)}  # so it is not judged again
    return kept.select(*[known[x].alias(x) if x in known else F.col(x) for x in kept.columns])
