"""Whole pipelines, composed from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.functions import names
from leakframe.operators import detect, secrets
from leakframe.operators.bloom import Bloom
from leakframe.operators.paths import history_skipped, keep_history, keep_scannable
from leakframe.operators.rules import Rule, ScanConfig
from leakframe.session import cut_lineage
from leakframe.sources.readers import decode_text, history


def scan_files(files: DataFrame, rules: list[Rule], config: ScanConfig | None = None) -> DataFrame:
    """Directory scan: path filters, matches, verdicts.  One narrow stage."""
    config = config or ScanConfig()
    return detect.scan(keep_scannable(files, config), rules, config)


def scan_history(
    blobs: DataFrame, rules: list[Rule], config: ScanConfig | None = None, branch: str | None = None
) -> DataFrame:
    """History scan of ``schemas.BLOBS``: matches with their commit.  No text is shuffled."""
    config = config or ScanConfig()
    kept = keep_history(blobs, branch)
    return detect.scan(history(kept), rules, config)


def scan_history_once(
    revisions: DataFrame, contents: DataFrame, rules: list[Rule], config: ScanConfig | None = None
) -> DataFrame:
    """History scan where each distinct text is matched once.

    ``revisions`` is narrow (repo, branch, commit_hash, commit_seq, commit_ts, path, blob_sha);
    ``contents`` holds each text at least once (blob_sha, content).  Texts are matched without a
    shuffle; only matches join the revisions, and path rules apply after that.  Path-dependent
    parts of the entropy operator are applied to the joined rows.
    """
    config = config or ScanConfig()
    texts = contents.select("blob_sha", F.lit("").alias("path"), decode_text(F.col("content")).alias("content"))
    found = detect.find_matches(texts, rules, config).drop("path")
    # a text that came twice has the same matches twice
    found = found.dropDuplicates(["blob_sha", "detector", "rule_ord", "rule_id", "match_start"])
    kept = revisions.where(~history_skipped(F.col("path")))
    placed = kept.join(found, "blob_sha")
    if config.profile != "fast":
        placed = placed.where((F.col("detector") == "rule") | ~detect.entropy_path_skipped(F.col("path")))
    return detect.judge(placed, rules, config)


def split_blobs(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions, contents) from blobs with text in every row.

    Texts are hashed where they are read, and one revision of each hash is picked on narrow rows.
    Two filters of bounded size go to the texts: the hashes that occur more than once, and the picked
    revisions of those.  A text outside the first is the only one of its kind; a text inside it
    stays if its revision is in the second.  So no text is shuffled or sorted, whatever the number of
    texts.  Filters err on one side: now and then a text comes twice, none is ever lost."""
    key = [c for c in ("repo", "branch", "commit_hash", "path") if c in blobs.columns]
    sha = F.sha2("content", 256)
    # null parts of a key differ from empty ones
    revision = F.sha2(F.concat_ws("\n", F.col("blob_sha"), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in key]), 256)
    revisions = blobs.withColumn("blob_sha", sha).drop("content")
    picks = cut_lineage(
        revisions.withColumn("_revision", revision).groupBy("blob_sha").agg(F.min("_revision").alias("_pick"), F.count(F.lit(1)).alias("_n"))
    )
    repeated = Bloom(picks.where("_n > 1"), "blob_sha")
    picked = Bloom(repeated.mark(picks, F.col("blob_sha"), "_maybe").where("_maybe"), "_pick")
    texts = blobs.select(*key, "content").withColumn("blob_sha", sha).withColumn("_revision", revision)
    texts = picked.mark(repeated.mark(texts, F.col("blob_sha"), "_maybe"), F.col("_revision"), "_mine")
    return revisions, texts.where(~F.col("_maybe") | F.col("_mine")).select("blob_sha", "content")


def unique_secrets(judged: DataFrame, prefix: str = "APP_") -> DataFrame:
    """Findings of a history scan folded to one named row per secret."""
    return secrets.name_secrets(secrets.fold(detect.findings(judged)), prefix)


def exit_code(findings: DataFrame) -> DataFrame:
    """One row: 2 if any critical, 1 if any high, else 0."""
    worst = F.max(
        F.when(F.col("severity") == "critical", F.lit(2)).when(F.col("severity") == "high", F.lit(1)).otherwise(F.lit(0))
    )
    return findings.agg(F.coalesce(worst, F.lit(0)).alias("exit_code"))


def dotnet_named(matches: DataFrame, prefix: str = "APP_") -> DataFrame:
    """Fast-profile matches with their JSON location as ``Section__Key`` names."""
    name = names.dotnet_name(
        F.col("json_section"), F.col("json_key"), F.col("secret_type"), F.col("path"), prefix
    )
    return matches.withColumn("env_var", name)
