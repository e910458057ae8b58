"""The driver's tables as inputs of the operators.

Every row comes from a given table, so work grows with the tables.  The configuration files are a
template filled from ``customer``; the branches it does not reach have fixtures in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.operators.rules import Rule, ScanConfig
from leakframe.sources.readers import SPREAD_ROWS, spread

RULES = [
    Rule("auth_token", "Auth Token", r'\btoken\s*=\s*"([^"]+)"', "auth_token", "high",
         "Token in an assignment", "Load the token from the environment", 1),
    Rule("card_number", "Card Number", r"\b\d{16}\b", "card_number", "critical",
         "Sixteen digits", "Remove the number", 2),
    Rule("email", "Email Address", r"[a-z0-9._]+@[a-z0-9.]+[a-z0-9]", "username", "medium",
         "Mail address", "Remove the address", 3),
    Rule("ip_address", "IP Address", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "ip_address", "low",
         "Address of a host", "Use a host name", 4),
]
CONFIG_RULES = [
    Rule("aws_access_key", "AWS Access Key", r"AKIA[A-Z0-9]{16}", "aws_access_key", "critical",
         "AWS access key id", "Rotate the key", 1),
    Rule("github_token", "GitHub Token", r"ghp_[a-zA-Z0-9]{36}", "github_token", "critical",
         "GitHub token", "Revoke the token", 2),
    Rule("api_key", "Generic API Key", r"sk_live_[a-zA-Z0-9]{20,}", "api_key", "high",
         "Live API key", "Rotate the key", 3),
    Rule("db_password", "Database Password", r'password\s*=\s*"[^"]+"', "database_password", "critical",
         "Password in a file", "Use a secret store", 4),
    Rule("json_secret", "JSON Secret", r'"(\w+)"\s*:\s*"([0-9a-f]{16,})"', "generic_secret", "medium",
         "Secret in JSON", "Use a secret store", 5),
]
NO_ENTROPY = ScanConfig(entropy_enabled=False)
CONFIG_PATHS = [
    "app/config.py", "web/app.js", "android/res/values.xml", "deploy/values.yml",
    "cfg/appsettings.json", "ci/Dockerfile", "lib/vendor.min.js", "tests/fixture_test.py",
    "docs/readme.md", "node_modules/index.js", "img/logo.png", "web/index.html",
]


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return d.select(
        F.col("lang").alias("repo"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read(spark, sf_dir, "pages", "page_id", "html"))
    return p.select(
        F.lit("web").alias("repo"),
        F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
    )


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as revisions: the source is the commit."""
    d = spread(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    seq = F.substring("source", 4, 10).cast("bigint")
    return d.select(
        F.col("lang").alias("repo"),
        F.when(seq % 2 == 0, F.lit("main")).otherwise(F.lit("remotes/dev")).alias("branch"),
        F.substring(F.sha2("source", 256), 1, 40).alias("commit_hash"),
        seq.alias("commit_seq"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=seq.cast("int"))).alias("commit_ts"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration file per customer, with keys made from the customer's name."""
    c = spread(read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), SPREAD_ROWS)
    h = F.sha2("c_name", 256)
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(p) for p in CONFIG_PATHS])
    lines = [
        F.lit("{"),
        F.concat(F.lit('  "'), F.col("c_mktsegment"), F.lit('": {')),
        F.concat(F.lit('    "ClientKey": "'), F.substring(h, 1, 32), F.lit('",')),
        F.concat(F.lit('    "Owner": "'), F.col("c_name"), F.lit('"')),
        F.lit("  }"),
        F.lit("}"),
        F.concat(F.lit('AWS_ACCESS_KEY_ID = "AKIA'), F.upper(F.substring(h, 1, 16)), F.lit('"')),
        F.concat(F.lit('db.password = "'), F.substring(h, 17, 14), F.lit('"; // primary')),
        F.concat(F.lit('const apiKey = "sk_live_'), F.substring(h, 20, 24), F.lit('"')),
        F.concat(F.lit("github: ghp_"), F.substring(h, 5, 36)),
        F.concat(F.lit('SECRET = "'), F.base64(F.unhex(h)), F.lit('"')),
        F.concat(F.lit('home = "https://docs.example.com/'), k.cast("string"), F.lit('"')),
    ]
    return c.select(
        F.col("c_mktsegment").alias("repo"),
        F.concat(
            F.lit("svc"), k.cast("string"), F.lit("/"),
            F.element_at(kinds, (k % len(CONFIG_PATHS) + 1).cast("int")),
        ).alias("path"),
        F.concat_ws("\n", *lines).alias("content"),
        k.alias("custkey"),
    )


def feedback_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review verdicts on documents; every distinct word of a document is a value."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    word = F.col("word")
    return d.join(labels, "doc_id").withColumn("word", F.explode(words)).select(
        F.col("source").alias("submission_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.substring("source", 4, 10).cast("int"))).alias("received_at"),
        F.sha2(word, 256).alias("value_hash"),
        word.alias("value"),
        F.when(F.col("toxic") == 1, F.lit("password")).otherwise(F.lit("api_key")).alias("secret_type"),
        F.lit("high").alias("severity"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, F.lit(".yml")).otherwise(F.lit(".py"))).alias("path"),
        (F.col("quality") == 1).alias("is_true_positive"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, line items as their secrets."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")
    counts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("total_secrets_found"),
        F.count_if(F.col("l_returnflag") == "R").alias("secrets_selected_for_cleaning"),
    )
    status = F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(
        F.col("o_orderstatus") == "P", F.lit("scanning")
    ).otherwise(F.lit("pending"))
    created = F.col("o_orderdate").cast("timestamp")
    return o.join(counts, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        created.alias("created_at"),
        (created + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        F.coalesce("total_secrets_found", F.lit(0)).alias("total_secrets_found"),
        F.coalesce("secrets_selected_for_cleaning", F.lit(0)).alias("secrets_selected_for_cleaning"),
    )


def job_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("id"),
        F.col("l_partkey").alias("part"),
        (F.col("l_returnflag") == "N").alias("is_false_positive"),
        (F.col("l_returnflag") == "R").alias("selected_for_cleaning"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    retries = F.get_json_object("props", "$.k").cast("int") % 7
    return e.select(
        F.col("event_id").alias("id"), "event_id", "event_type",
        F.col("user_id").alias("aggregate_id"), F.col("props").alias("payload"),
        (F.col("value") > 20).alias("published"),
        F.when(F.col("value") > 20, F.col("ts")).alias("published_at"),
        F.coalesce(retries, F.lit(0)).alias("retry_count"),
        F.col("ts").alias("created_at"),
    )


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a rule catalog."""
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    severity = (
        F.when(F.col("p_size") > 40, F.lit("critical")).when(F.col("p_size") > 25, F.lit("high"))
        .when(F.col("p_size") > 10, F.lit("medium")).otherwise(F.lit("low"))
    )
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit("-"), "p_partkey").alias("name"),
        F.lower("p_type").alias("secret_type"), severity.alias("severity"),
        F.col("p_brand").alias("description"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as repository objects, with their sizes."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sha"), F.col("source").alias("path"),
        F.lit("blob").alias("type"), F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    p = read(spark, sf_dir, "pages", "page_id", "html").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("sha"), F.lit(None).cast("string").alias("path"),
        F.when(F.col("page_id") % 5 == 0, F.lit("tree")).otherwise(F.lit("blob")).alias("type"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
    )
    return d.unionByName(p)
