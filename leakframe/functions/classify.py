"""Classes of findings, files and technologies as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import text
from leakframe.functions.regex import contains_any, hits

_ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def finding_category(secret_type: Column, context: Column, value: Column) -> Column:
    """Category from type, context and value; the type itself when nothing fits."""
    ctx = F.lower(F.coalesce(context, F.lit("")))
    val = F.lower(F.coalesce(value, F.lit("")))
    return (
        F.when(ctx.contains("azure") | val.contains("database.windows.net"), F.lit("azure_sql"))
        .when(contains_any(secret_type, ["sql", "database", "connection"]), F.lit("sql_server"))
        .when(secret_type.contains("rabbitmq") | val.contains("amqp://"), F.lit("rabbitmq"))
        .when(secret_type.contains("fcm") | val.contains("firebase"), F.lit("fcm"))
        .when(
            secret_type.contains("jwt") | F.translate(ctx, " ", "").contains("secretkey"), F.lit("jwt")
        )
        .when(secret_type.contains("vapid") | ctx.contains("vapid"), F.lit("vapid"))
        .when(secret_type.contains("ldap") | ctx.contains("ldap"), F.lit("ldap"))
        .when(hits(val, rf"\b{_ADDRESS}\b", ignore_case=False), F.lit("internal_ip"))
        .when(secret_type.contains("api") & secret_type.contains("key"), F.lit("api_key"))
        .otherwise(secret_type)
    )


def type_category(secret_type: Column) -> Column:
    """Category from the type alone."""
    low = F.lower(secret_type)
    return (
        F.when(low.contains("sql") & low.contains("azure"), F.lit("azure_sql"))
        .when(low.contains("sql"), F.lit("sql_server"))
        .when(contains_any(low, ["rabbit", "amqp"]), F.lit("rabbitmq"))
        .when(contains_any(low, ["fcm", "firebase"]), F.lit("fcm"))
        .when(low.contains("jwt"), F.lit("jwt"))
        .when(low.contains("vapid"), F.lit("vapid"))
        .when(low.contains("api") & low.contains("key"), F.lit("api_key"))
        .when(low.contains("aws") & low.contains("access"), F.lit("aws_access_key"))
        .when(low.contains("aws"), F.lit("aws_secret_key"))
        .otherwise(secret_type)
    )


def env_file_group(secret_type: Column) -> Column:
    low = F.lower(secret_type)
    groups = ((contains_any(low, words), F.lit(g)) for g, words in fv.ENV_FILE_GROUPS)
    return F.coalesce(text.first_hit(groups), F.lit("other"))


def ci_group(name: Column, secret_type: Column) -> Column:
    name, kind = F.lower(name), F.lower(secret_type)
    return (
        F.when(name.contains("connection") | kind.contains("connectionstring"), F.lit("connection_strings"))
        .when(name.contains("api") | kind.contains("apikey"), F.lit("api_keys"))
        .when(
            contains_any(name, ["auth", "oauth", "client_secret", "password", "token"]),
            F.lit("authentication"),
        )
        .when(contains_any(name, ["key", "private", "secret", "encrypt"]), F.lit("encryption_keys"))
        .otherwise(F.lit("other"))
    )


def file_class(path: Column) -> Column:
    low, name = F.lower(path), F.lower(text.base_name(path))
    ext = text.extension(path)
    android = low.contains("android")
    return (
        F.when(name.isin(fv.CONFIG_NAMES) | ext.isin(fv.CONFIG_EXTENSIONS), F.lit("config"))
        .when((ext == ".xml") & android, F.lit("android_xml"))
        .when(ext.isin(".kt", ".java") & android, F.lit("android_code"))
        .when(name.isin("build.gradle", "build.gradle.kts"), F.lit("gradle"))
        .when(ext == ".plist", F.lit("ios_plist"))
        .when(ext == ".swift", F.lit("swift"))
        .when(ext.isin(".js", ".ts", ".jsx", ".tsx"), F.lit("javascript"))
        .when(ext == ".py", F.lit("python"))
        .when(
            path.contains("github/workflows") | contains_any(name, ["gitlab-ci", "jenkinsfile"]),
            F.lit("cicd"),
        )
        .when(name.contains("dockerfile") | (name == "docker-compose.yml"), F.lit("docker"))
        .otherwise(F.lit("other"))
    )


def language(path: Column) -> Column:
    return F.coalesce(
        text.lookup(text.base_name(path), fv.LANGUAGE_BY_NAME),
        text.lookup(text.extension(path), fv.LANGUAGE_BY_EXTENSION),
        F.lit("unknown"),
    )


def type_of_rule_name(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(
        text.first_hit((low.contains(k), F.lit(v)) for k, v in fv.TYPE_BY_RULE_NAME), F.lit("other")
    )


def coarse_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("password"), F.lit("password"))
        .when(contains_any(low, ["api", "key"]), F.lit("api_key"))
        .when(low.contains("token"), F.lit("token"))
        .when(low.contains("private"), F.lit("private_key"))
        .when(low.contains("connection"), F.lit("connection_string"))
        .otherwise(F.lit("other"))
    )


def priority(critical: Column, high: Column) -> Column:
    return (
        F.when(critical > 0, F.lit("urgent")).when(high > 0, F.lit("high")).otherwise(F.lit("medium"))
    )


def severity_rank(severity: Column) -> Column:
    ranks = {k: str(v) for k, v in fv.SEVERITY_RANK.items()}
    return F.coalesce(text.lookup(F.lower(severity), ranks).cast("int"), F.lit(0))


def severity_score(severity: Column) -> Column:
    scores = {k: str(v) for k, v in fv.SEVERITY_SCORE.items()}
    return F.coalesce(text.lookup(F.lower(severity), scores).cast("int"), F.lit(0))


def _techs(tests: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(tech)) for tech, cond in tests]))


def technologies_in_findings(findings: DataFrame) -> DataFrame:
    """One row per repo and technology, from path, context and value of its findings.

    Tests run per row, so the text of a repo is never put together.
    """
    blob = F.concat(
        F.lit(" "), F.col("path"), F.lit(" "), F.coalesce("context", F.lit("")),
        F.lit(" "), F.coalesce("exposed_value", F.lit("")),
    )
    # ``$`` patterns look at the end of the joined text; per row they look at the path
    tests = []
    for tech, patterns in fv.TECH_IN_TEXT.items():
        anchored = [p for p in patterns if p.endswith("$")]
        free = [p for p in patterns if not p.endswith("$")]
        conds = ([hits(F.col("_blob"), free)] if free else []) + (
            [hits(F.col("path"), anchored)] if anchored else []
        )
        tests.append((tech, reduce(lambda a, b: a | b, conds)))
    return (
        findings.withColumn("_blob", blob)
        .select("repo", F.explode(_techs(tests)).alias("technology"))
        .distinct()
    )


def technologies_in_tree(files: DataFrame) -> DataFrame:
    """One row per repo and technology, from tracked paths and three content words."""
    from leakframe.operators.paths import path_glob

    path, ext = F.col("path"), text.extension(F.col("path"))
    tests = [(tech, path_glob(path, glob)) for glob, tech in fv.TECH_BY_PATH.items()]
    if "content" in files.columns:
        tests += [
            (word, ext.isin(exts) & F.col("content").contains(word))
            for word, exts in fv.TECH_BY_CONTENT
        ]
    return files.select("repo", F.explode(_techs(tests)).alias("technology")).distinct()
