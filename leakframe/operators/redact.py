"""Purge selection, redaction of texts and rewriting of assignment lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import classify, names, text
from leakframe.functions.regex import contains_any, escape, flags, to_java
from leakframe.operators import anchors
from leakframe.operators.bloom import Bloom
from leakframe.operators.secrets import drop_covered_partials
from leakframe.session import BROADCAST_BYTES, cut_lineage, measured, small_side, written


# ------------------------------------------------------------------ selection
def _breaks_line(value: Column) -> Column:
    return contains_any(value, ["\u0000", "\n", "\r"])


def select_purge(secrets: DataFrame) -> DataFrame:
    """Values to remove, fast form: 8+ characters, no common word, one line, not covered by a
    full connection string, distinct."""
    value = F.col("value")
    # a full string covers its parts whatever its own length or form
    kept = drop_covered_partials(secrets).where(
        (F.length(value) >= 8) & ~value.isin(fv.PURGE_COMMON_WORDS) & ~_breaks_line(value)
    )
    return kept.select("value").distinct().withColumn("replacement", F.lit(""))


def select_purge_plain(secrets: DataFrame, use_env: bool = False) -> DataFrame:
    """Older form: 4+ characters, one line; placeholder or variable as replacement."""
    value = F.col("value")
    kept = secrets.where((F.length(value) >= 4) & ~_breaks_line(value))
    removed = F.lit(fv.REMOVED)
    replacement = F.coalesce(F.concat(F.lit("${"), F.nullif(F.col("env_var"), F.lit("")), F.lit("}")), removed) if use_env else removed
    return kept.withColumn("replacement", replacement)


def purge_line(value: Column, replacement: Column) -> Column:
    """``value==>replacement``; a value that holds the arrow itself goes as an escaped regex."""
    left = F.when(value.contains("==>"), F.concat(F.lit("regex:"), escape(value))).otherwise(value)
    return F.concat(left, F.lit("==>"), replacement)


def _bfg_left(value: Column) -> Column:
    special = value.contains("#") | value.contains("\\")
    return F.when(special, F.concat(F.lit("regex:"), escape(value))).otherwise(value)


def select_bfg(findings: DataFrame, placeholders: bool = True) -> DataFrame:
    """Purge list by category: one row per distinct value of 4+ characters that is not markup,
    comment or code.  A value in two categories goes to the first by name."""
    value = F.col("value")
    category = classify.finding_category(F.col("secret_type"), F.col("context"), F.col("exposed_value"))
    code = value.startswith("<") | value.startswith("//") | F.lower(value).contains("function")
    chosen = (
        findings.where((F.length(value) >= 4) & ~code)
        .groupBy("value")
        .agg(F.min(category).alias("category"))
    )
    word = F.coalesce(text.lookup(F.col("category"), fv.PLACEHOLDER_BY_CATEGORY), F.lit(fv.REMOVED))
    line = F.concat(_bfg_left(value), F.lit("==>"), word) if placeholders else _bfg_left(value)
    return chosen.select("category", "value", word.alias("replacement"), line.alias("line"))


def replacement_table(findings: DataFrame, prefix: str = "APP_") -> DataFrame:
    """Distinct values per category with ``NAME_REMOVED``; first finding gives the name."""
    kept = findings.where(F.length("value") >= 4)
    ordered = F.struct("path", "line_number", "rule_ord", "match_start")
    chosen = kept.groupBy(
        classify.type_category(F.col("secret_type")).alias("category"), "value"
    ).agg(F.min_by("secret_type", ordered).alias("_type"))
    name = F.concat(F.upper(names.report_env_name(F.col("_type"), prefix)), F.lit("_REMOVED"))
    return chosen.select("category", "value", name.alias("replacement")).withColumn(
        "line", F.concat(_bfg_left(F.col("value")), F.lit("==>"), F.col("replacement"))
    )


# ------------------------------------------------------------------ redaction
HEAD = 128  # bytes of a value that are compared where its first bytes stand
PIECE = 512  # tests put values across multiples of it


def _listed(purge: DataFrame) -> DataFrame:
    """The values of a purge list, each once: ``value``, ``replacement`` and its length ``n``."""
    replacement = F.coalesce("replacement", F.lit("")) if "replacement" in purge.columns else F.lit("")
    rows = purge.where(F.col("value") != "").groupBy("value").agg(F.min(replacement).alias("replacement"))
    return cut_lineage(rows.withColumn("n", F.length("value")))


def _held(rows: DataFrame, key: str, side: DataFrame, limit: int, how: str) -> DataFrame:
    """``rows`` joined with a narrow ``side``, which is broadcast up to ``limit`` bytes.  Beyond it a
    Bloom filter of bounded size goes to the rows, and only rows that it lets pass are shuffled."""
    kept, size = measured(side)
    if size <= limit:
        return rows.join(F.broadcast(kept), key, how)
    marked = Bloom(kept.select(key), key).mark(rows, F.col(key), "_may")
    joined = marked.where("_may").drop("_may").join(kept, key, how)
    if how == "inner":
        return joined
    return joined.unionByName(marked.where("NOT _may").drop("_may"), allowMissingColumns=True)


class ValueIndex:
    """Values by their first bytes, for several searches: ``value``, bytes ``n``, ``head`` and its bytes ``m``."""

    def __init__(self, values: DataFrame):
        raw = F.col("value").cast("binary")
        head = F.substring(raw, 1, HEAD)
        self.heads = cut_lineage(values.select(
            "value", F.octet_length(raw).alias("n"), head.alias("head"), F.octet_length(head).alias("m"),
            F.substring(raw, 1, anchors.ANCHOR).alias("anchor"),
        ))
        self.most = self.heads.agg(F.max("n")).first()[0]
        self.anchors = anchors.Anchors(self.heads) if self.most else None


def occurrences(texts: DataFrame, values: DataFrame, limit: int = BROADCAST_BYTES, index: ValueIndex | None = None) -> DataFrame:
    """Distinct ``key`` and ``value``: which of the ``values`` (``value``, ``n``) stand in ``texts`` (``key``, ``body``).

    Neither pairs of texts and values are built nor texts shuffled.  Only places that hold the first
    bytes of some value leave a text (``anchors.spots``).  Such a place asks for one head of each
    length that values with this beginning have, whatever their number, and those meet the values by
    equality.  Of long values the first ``HEAD`` bytes meet, then the whole value is searched."""
    index = index or ValueIndex(values)
    if not index.most:
        return texts.select("key", F.lit("").alias("value")).limit(0)
    heads, most = index.heads, index.most
    places = anchors.spots(texts, index.anchors, HEAD)
    asked = _held(places, "anchor", heads.select("anchor", "m").distinct(), limit, "inner").where(F.octet_length("tail") >= F.col("m"))
    found = asked.select("key", F.substring("tail", F.lit(1), F.col("m")).alias("head")).distinct()
    met = cut_lineage(found.join(heads.select("value", "n", "head"), "head").select("key", "value", "n"))
    if most <= HEAD:
        return met.select("key", "value")
    long = met.where(F.col("n") > HEAD).select("key", "value")
    whole = _held(texts, "key", long, limit, "inner").where(F.col("body").contains(F.col("value"))).select("key", "value")
    return met.where(F.col("n") <= HEAD).select("key", "value").unionByName(whole.distinct())


def literal_hits(files: DataFrame, purge: DataFrame, keys: list[str], content: str = "content", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Files (``keys``) and the purge values that stand in them, reported by a rule or not."""
    texts = files.select(F.sha2(content, 256).alias("key"), F.col(content).alias("body"))
    hits = occurrences(texts, _listed(purge), limit)
    return files.select(*keys, F.sha2(content, 256).alias("_text")).join(
        hits.withColumnRenamed("key", "_text"), "_text"
    ).select(*keys, "value")


def _replaced(body: Column, values: Column, longest: int) -> Column:
    """``text`` after all replacements in turn, and ``around``: what stands around each of them, wide
    enough to hold any value that a replacement brings into being."""
    reach = longest - 1

    def one(state: Column, pair: Column) -> Column:
        parts = F.split(state["text"], escape(pair["value"]), -1)
        ends = F.transform(parts, lambda p: F.when(
            F.length(p) > 2 * reach, F.concat(F.substring(p, 1, reach), F.right(p, F.lit(reach)))
        ).otherwise(p))
        after = F.struct(
            F.replace(state["text"], pair["value"], pair["replacement"]).alias("text"),
            F.concat(state["around"], F.array(F.call_function("array_join", ends, pair["replacement"]))).alias("around"),
        )
        return F.when(state["text"].contains(pair["value"]), after).otherwise(state)

    none = F.array().cast("array<string>")
    start = F.struct(body.alias("text"), none.alias("around"))
    return F.when(values.isNull(), start).otherwise(F.aggregate(values, start, one))


def redact_everywhere(files: DataFrame, purge: DataFrame, content: str = "content", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Replace every purge value wherever it stands in any text, longest first, then by value.

    A secret is removed also where no rule reported it.  The result is that of a loop over the whole
    list, but a text tries only values that stand in it (``occurrences``).  A replacement can bring
    another value into being: what stands around the replacements is searched again, and as long as
    this finds values that a text did not try, the texts are cleaned anew with them.  Texts stay in
    their tasks and are stored when clean, since sinks and both checks read them.  Needs ``value``
    and ``replacement`` (default: nothing)."""
    values = _listed(purge)
    longest = values.agg(F.max("n")).first()[0]
    if longest is None:
        return files
    keyed = files.withColumn("_text", F.sha2(content, 256))
    texts = keyed.select(F.col("_text").alias("key"), F.col(content).alias("body"))
    index = ValueIndex(values)
    found = cut_lineage(occurrences(texts, values, limit, index))
    order = F.struct((-F.col("n")).alias("n"), "value", "replacement")
    while True:
        lists = found.join(values, "value").groupBy(F.col("key").alias("_text")).agg(F.array_sort(F.collect_list(order)).alias("_values"))
        done = _held(keyed, "_text", lists, limit, "left").withColumn("_done", _replaced(F.col(content), F.col("_values"), longest))
        clean = written(done.drop("_values"), "redacted")
        around = clean.select(F.col("_text").alias("key"), F.explode("_done.around").alias("body"))
        more = cut_lineage(occurrences(around, values, limit, index).join(found, ["key", "value"], "left_anti"))
        if more.isEmpty():
            return clean.select(*[F.col("_done.text").alias(c) if c == content else F.col(c) for c in files.columns])
        found = cut_lineage(found.unionByName(more))


# ------------------------------------------------------------------ rewriting
def env_reference(language: Column, name: Column) -> Column:
    """Expression that reads an environment variable in a language."""
    mark = "\u0001"
    table = {k: v.format(mark) for k, v in fv.ENV_REFERENCE.items()}
    syntax = F.coalesce(text.lookup(language, table), F.lit(table["unknown"]))
    return F.replace(syntax, F.lit(mark), name)


def rewrite_line(language: Column, name: Column, line: Column) -> Column:
    """Assignment with the value replaced by a reference to the variable.

    Names are quoted in patterns and in replacements, so any name is taken as it is."""
    literal, name = escape(name), F.regexp_replace(name, r"([\\$])", r"\\$1")
    quoted, maybe_quoted, before = fv.REWRITE_QUOTED, fv.REWRITE_MAYBE_QUOTED, fv.REWRITE_BEFORE
    ref = F.concat(F.lit('$1"\\${'), name, F.lit('}"'))
    exact, folded = flags(ignore_case=False), flags()
    by_name = F.concat(F.lit(folded + "("), literal, F.lit(to_java(rf"\s*[:=]\s*){maybe_quoted}")))

    def fixed(pattern: str, opens: str, closes: str) -> Column:
        whole = exact + to_java(pattern + quoted)
        return F.regexp_replace(line, F.lit(whole), F.concat(F.lit("$1" + opens), name, F.lit(closes)))

    return (
        F.when(
            language == "bash",
            F.regexp_replace(
                line,
                F.concat(F.lit(exact + "("), literal, F.lit(to_java(r"\s*=\s*)" + fv.REWRITE_BASH_VALUE))),
                ref,
            ),
        )
        .when(
            language == "python",
            F.regexp_replace(
                line,
                F.concat(
                    F.lit(folded + to_java(r"(\s*")), literal, F.lit(to_java(r"\s*=\s*)" + quoted))
                ),
                F.concat(F.lit("$1os.environ.get('"), name, F.lit("')")),
            ),
        )
        .when(language.isin("javascript", "typescript"), fixed(before["javascript"], "process.env.", ""))
        .when(language == "java", fixed(before["java"], 'System.getenv("', '")'))
        .when(language == "go", fixed(before["go"], 'os.Getenv("', '")'))
        .when(language == "ruby", fixed(before["ruby"], "ENV['", "']"))
        .when(language == "php", fixed(before["php"], "getenv('", "')"))
        .otherwise(F.regexp_replace(line, by_name, ref))
    )


def plan_rewrites(files: DataFrame, requests: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """One row per request: the line before and after, or an error when it is out of range.

    ``requests`` has keys, line_number, var_name.  Requests join to their file once, as a list
    bounded by the file; only asked lines leave the text.
    """
    asked = requests.groupBy(*keys).agg(F.collect_list(F.struct("line_number", "var_name")).alias("_asked"))
    lang = classify.language(F.col("path"))
    found = files.join(small_side(asked), keys).select(
        *keys,
        lang.alias("language"),
        F.size(_lines("content")).alias("n_lines"),
        F.inline(
            F.transform(
                "_asked",
                lambda a: F.struct(
                    a.line_number.alias("line_number"),
                    a.var_name.alias("var_name"),
                    F.when(a.line_number >= 1, F.get(_lines("content"), a.line_number - 1)).alias("original_line"),
                ),
            )
        ),
    )
    new_line = rewrite_line(F.col("language"), F.col("var_name"), F.col("original_line"))
    out_of_range = F.concat(
        F.lit("Line "), F.col("line_number").cast("string"), F.lit(" out of range (file has "),
        F.col("n_lines").cast("string"), F.lit(" lines)"),
    )
    return (
        found.withColumn("new_line", new_line)
        .withColumn("changed", F.coalesce(F.col("new_line") != F.col("original_line"), F.lit(False)))
        .withColumn("success", F.col("original_line").isNotNull())
        .withColumn("error", F.when(~F.col("success"), out_of_range))
        .withColumn("import_needed", text.lookup(F.col("language"), fv.LANGUAGE_IMPORT))
    )


def _lines(content: str) -> Column:
    """Lines as a reader sees them: a final newline does not start another line."""
    parts = F.split(content, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def apply_rewrites(files: DataFrame, rewrites: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """Files with their rewritten lines in place.

    Several rewrites of a line apply in order of variable name, each to the result of the one
    before.  A file stays one row: rewritten lines go into its line array.
    """
    wanted = rewrites.where(F.col("success")).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("line_number", "var_name"))).alias("_wanted")
    )
    lang = classify.language(F.col("path"))
    lines = F.split("content", "\n", -1)
    edited = F.transform(
        lines,
        lambda line, i: F.aggregate(
            F.filter(F.col("_wanted"), lambda w: w.line_number == i + 1),
            line,
            lambda acc, w: rewrite_line(lang, w.var_name, acc),
        ),
    )
    return (
        files.join(small_side(wanted), keys, "left")
        .withColumn("content", F.when(F.col("_wanted").isNull(), F.col("content")).otherwise(F.array_join(edited, "\n")))
        .drop("_wanted")
    )


def rewrite_summary(rewrites: DataFrame) -> DataFrame:
    done = F.col("success")
    return rewrites.agg(
        F.countDistinct(F.when(done, F.col("path"))).alias("files_modified"),
        F.count_if(done).alias("replacements_made"),
        F.count_if(~done).alias("errors"),
    )


def preview(rewrites: DataFrame) -> DataFrame:
    return rewrites.select(
        "path", "line_number", F.col("var_name").alias("variable"),
        F.col("original_line").alias("before"), F.col("new_line").alias("after"), "error",
    )


def dry_run(secrets: DataFrame, large: DataFrame) -> DataFrame:
    """Counters of what a clean would do, without doing it."""
    counts = secrets.select(F.lit("secrets_removed").alias("counter")).unionByName(
        large.select(F.lit("large_files_removed").alias("counter"))
    )
    return counts.agg(
        F.count_if(F.col("counter") == "secrets_removed").alias("secrets_removed"),
        F.count_if(F.col("counter") == "large_files_removed").alias("large_files_removed"),
    )


