"""Names for secrets: environment variables and CI variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import text
from leakframe.functions.regex import group
from leakframe.operators.ranking import number_within, prefix_sum
from leakframe.session import cut_lineage


def _stem_upper(path: Column) -> Column:
    return F.upper(text.stem(path))


def env_name(secret_type: Column, path: Column, prefix: str = "APP_") -> Column:
    """Name by type, with the file stem in front unless the stem is generic."""
    base = F.coalesce(text.lookup(secret_type, fv.ENV_BY_TYPE), F.lit("SECRET"))
    file_stem = _stem_upper(path)
    plain = (file_stem == "") | file_stem.isin(fv.ENV_GENERIC_STEMS)
    return F.concat(F.lit(prefix), F.when(plain, F.lit("")).otherwise(F.concat(file_stem, F.lit("_"))), base)


def env_name_fast(secret_type: Column, path: Column, prefix: str = "APP_") -> Column:
    file_stem = _stem_upper(path)
    plain = (file_stem == "") | file_stem.isin(fv.FAST_GENERIC_STEMS)
    return F.concat(
        F.lit(prefix),
        F.when(plain, F.lit("")).otherwise(F.concat(file_stem, F.lit("_"))),
        F.upper(secret_type),
    )


def value_keyword(value: Column) -> Column:
    """First service keyword inside a value, NULL if none."""
    low = F.lower(value)
    return text.first_hit((low.contains(k), F.lit(v)) for k, v in fv.VALUE_KEYWORDS)


def _type_word(secret_type: Column) -> Column:
    return F.translate(F.upper(secret_type), "- ", "__")


def history_env_name(value: Column, secret_type: Column, path: Column, prefix: str = "APP_") -> Column:
    """At most two of parent directory, file stem and value keyword, then type, then 4 hex."""
    generic = fv.HISTORY_GENERIC_NAMES
    parent, file_stem = F.upper(text.parent_name(path)), _stem_upper(path)
    useful = lambda c: F.when((c != "") & ~c.isin(generic), c)
    parts = F.slice(F.array_compact(F.array(useful(parent), useful(file_stem), value_keyword(value))), 1, 2)
    kind = F.coalesce(text.lookup(secret_type, fv.HISTORY_ENV_BY_TYPE), _type_word(secret_type))
    tag = F.upper(F.substring(text.sha256(value), 1, 4))
    named = F.concat(F.lit(prefix), F.concat_ws("_", parts, kind, tag))
    return F.translate(F.replace(named, F.lit("__"), F.lit("_")), "-", "_")


def history_env_name_old(secret_type: Column, path: Column, prefix: str = "APP_") -> Column:
    """Older form: the type alone, the stem only for the generic type."""
    kind = F.coalesce(text.lookup(secret_type, fv.HISTORY_ENV_BY_TYPE), _type_word(secret_type))
    file_stem = _stem_upper(path)
    use_stem = (kind == "SECRET") & (file_stem != "") & ~file_stem.isin(fv.OLD_GENERIC_STEMS)
    return F.concat(
        F.lit(prefix), F.when(use_stem, F.concat(file_stem, F.lit("_SECRET"))).otherwise(kind)
    )


def dotnet_name(section: Column, key: Column, secret_type: Column, path: Column, prefix: str = "APP_") -> Column:
    """``Section__Key`` form from the JSON location of a value."""
    section, key = F.nullif(section, F.lit("")), F.nullif(key, F.lit(""))
    file_stem = F.when(F.coalesce(path, F.lit("")) == "", F.lit("UNKNOWN")).otherwise(text.stem(path))
    body = F.coalesce(
        F.concat(section, F.lit("__"), key),
        key,
        F.concat(file_stem, F.lit("__"), _type_word(secret_type)),
    )
    return F.regexp_replace(F.concat(F.lit(prefix), body), "[^A-Za-z0-9_]", "_")


def report_env_name(secret_type: Column, prefix: str = "APP_") -> Column:
    return F.concat(
        F.lit(prefix), F.coalesce(text.lookup(secret_type, fv.REPORT_ENV_BY_TYPE), F.upper(secret_type))
    )


def generated_env_name(secret_type: Column, prefix: str = "APP_") -> Column:
    """Base name that ``make_unique`` numbers."""
    return F.concat(
        F.lit(prefix),
        F.coalesce(text.lookup(secret_type, fv.GENERATED_ENV_BY_TYPE), F.lit("SECRET_VALUE")),
    )


def sanitize(name: Column, prefix: str = "APP_") -> Column:
    """Valid name for an env file: prefix off, upper case, no leading digit."""
    bare = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    clean = F.regexp_replace(F.upper(bare), "[^A-Za-z0-9_]", "_")
    return F.when(F.rlike(clean, F.lit("^[0-9]")), F.concat(F.lit("_"), clean)).otherwise(clean)


def ci_name(section: Column, key: Column, secret_type: Column, path: Column) -> Column:
    """CI variable name without prefix; runs of underscores collapse."""
    section = F.coalesce(section, F.lit(""))
    key = F.coalesce(key, F.lit(""))
    file_stem = F.translate(text.stem(path), ".-", "__")
    kind = F.regexp_replace(secret_type, "[^a-zA-Z0-9]", "_")
    body = (
        F.when((section != "") & (key != ""), F.concat(section, F.lit("__"), key))
        .when(key != "", key)
        .otherwise(F.concat(file_stem, F.lit("__"), kind))
    )
    clean = F.regexp_replace(F.regexp_replace(body, "[^a-zA-Z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(clean, "^_+|_+$", "")


def clean_value(raw: Column) -> Column:
    """Inner value of ``key": "value"`` or ``key = "value"``, else the text itself."""
    return F.coalesce(
        group(raw, r"""^\w+["']?\s*:\s*["'](.+?)["']?$""", 1, ignore_case=False),
        group(raw, r"""^\w+\s*=\s*["'](.+?)["']$""", 1, ignore_case=False),
        raw,
    )


def make_unique(df: DataFrame, base: str, order: list, out: str = "env_var") -> DataFrame:
    """Number equal names: the first keeps it, the next get ``_1``, ``_2`` and so on.

    A number is skipped when the numbered name is somebody's own name (``A_1`` in the input).
    Names are numbered range by range (see ``ranking``): one name may belong to any share of rows.
    """
    df = cut_lineage(df)  # ranges are sampled first: without this the input would run twice
    numbered = number_within(df, [base], order, "_n")
    own = df.select(F.col(base).alias("_own")).distinct()
    # no table has 10**18 rows, so a longer number is never given
    form = r"(?s)^(.*)_([1-9][0-9]{0,17})\z"
    taken = (
        own.select(
            F.regexp_extract("_own", form, 1).alias(base),
            F.regexp_extract("_own", form, 2).try_cast("bigint").alias("_hole"),
        )
        .where(F.col("_hole").isNotNull())
        .join(own.select(F.col("_own").alias(base)), base, "left_semi")
    )
    if not taken.isEmpty():
        numbered = _skip_taken(numbered, taken, base)
    name = F.when(F.col("_n") == 0, F.col(base)).otherwise(
        F.concat(F.col(base), F.lit("_"), F.col("_n").cast("string"))
    )
    return numbered.withColumn(out, name).drop("_n")


def _skip_taken(numbered: DataFrame, taken: DataFrame, base: str) -> DataFrame:
    """Give row n the n-th number that is not taken.

    The i-th taken number h moves every row with n > h - i (i from 1), so the shift of a row is
    a running count of those thresholds over rows and thresholds together.
    """
    ranked = number_within(taken, [base], ["_hole"], "_i")
    limits = ranked.select(base, (F.col("_hole") - F.col("_i")).alias("_n"), F.lit(1).alias("_is_hole"))
    both = numbered.withColumn("_is_hole", F.lit(0)).unionByName(limits, allowMissingColumns=True)
    shifted = prefix_sum(
        both, [base], ["_n", F.col("_is_hole").desc()], F.col("_is_hole").cast("bigint"), "_shift"
    )
    moved = F.when(F.col("_n") == 0, F.lit(0)).otherwise(F.col("_n") + F.col("_shift"))
    return shifted.where(F.col("_is_hole") == 0).withColumn("_n", moved).select(*numbered.columns)
