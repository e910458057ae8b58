"""Row filters on files and paths.  They read only ``path`` and ``size_bytes``, so they run
before a task touches the text, and size filters reach the file source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe.functions import text
from leakframe.functions.regex import hits, to_java
from leakframe.operators.rules import ScanConfig, usable


def binary_extension(path: Column, extensions: list[str] = fv.SKIP_EXTENSIONS) -> Column:
    return text.extension(path).isin(extensions)


def in_git_dir(path: Column) -> Column:
    return path.startswith(".git/") | path.contains("/.git/") | (path == "/.git")


def allowlisted(path: Column, patterns: list[str]) -> Column:
    """A path an allowlist regex finds is not scanned (case-sensitive)."""
    patterns = usable(patterns)
    return hits(path, patterns, ignore_case=False) if patterns else F.lit(False)


def glob_excluded(path: Column, globs: list[str]) -> Column:
    """With a star: any named part equals a path component.  Without: substring."""
    out = F.lit(False)
    parts: list[str] = []
    for glob in (g.replace("\\", "/") for g in globs):
        if "*" in glob:
            parts += [p for p in glob.replace("*", "").split("/") if p]
        else:
            out = out | path.contains(glob)
    if parts:
        components = F.array(*[F.lit(p) for p in dict.fromkeys(parts)])
        out = out | F.arrays_overlap(F.split(path, "/"), components)
    return out


def glob_included(path: Column, globs: list[str]) -> Column:
    """``**/*.ext`` is a suffix test, other ``**/`` forms never match, the rest match from the
    right, component by component.  No globs keep everything."""
    if not globs:
        return F.lit(True)
    out = F.lit(False)
    for glob in (g.replace("\\", "/") for g in globs):
        if glob.startswith("**/"):
            if glob[3:].startswith("*."):
                out = out | path.endswith(glob[4:])
        else:
            out = out | F.rlike(path, F.lit(_right_match(glob)))
    return out


def glob_component(part: str) -> str:
    """Regex for one glob component: ``*``, ``?`` and ``[...]`` stay inside the component."""

    def piece(m: re.Match) -> str:
        token = m.group(0)
        if token == "*":
            return "[^/]*"
        if token == "?":
            return "[^/]"
        if token.startswith("["):
            body = token[1:-1].replace("\\", r"\\")
            return "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
        return re.escape(token)

    return re.sub(r"\*+|\?|\[!?[^\]]+\]|[^*?\[]+|\[", lambda m: piece(m), part.replace("**", "*"))


def _right_match(glob: str) -> str:
    parts = [glob_component(p) for p in glob.split("/") if p]
    head = "^/" if glob.startswith("/") else "(?:^|/)"
    return "(?d)" + to_java(head + "/".join(parts)) + r"\z"


def scannable(path: Column, config: ScanConfig) -> Column:
    """Path part of a scan: allowlist, .git, exclude and include globs."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        ~allowlisted(path, config.path_allowlist)
        & ~in_git_dir(path)
        & ~glob_excluded(path, config.file_excludes)
        & glob_included(path, config.file_includes)
    )


def fast_skipped(path: Column) -> Column:
    return binary_extension(path, fv.FAST_SKIP_EXTENSIONS) | hits(F.lower(path), fv.FAST_SKIP_PATH)


def history_skipped(path: Column) -> Column:
    return (
        binary_extension(path, fv.HISTORY_SKIP_EXTENSIONS)
        | text.base_name(path).isin(fv.HISTORY_SKIP_NAMES)
        | F.arrays_overlap(
            F.split(path, "/"), F.array(*[F.lit(d) for d in fv.HISTORY_SKIP_DIRS])
        )
    )


def keep_scannable(files: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """All file filters of a directory scan."""
    config = config or ScanConfig()
    path = F.col("path")
    kept = files
    if "size_bytes" in files.columns:
        kept = kept.where(F.col("size_bytes") <= config.max_file_size)
    if config.profile == "fast":
        return kept.where(~fast_skipped(path))
    return kept.where(~binary_extension(path) & scannable(path, config))


def keep_history(blobs: DataFrame, branch: str | None = None) -> DataFrame:
    """Blobs worth scanning, of one branch or of all."""
    kept = blobs.where(~history_skipped(F.col("path")))
    return kept.where(F.col("branch") == branch) if branch else kept


def path_glob(path: Column, glob: str) -> Column:
    """Tracked-file glob: matches at any depth by the whole path or its last part."""
    return F.rlike(path, F.lit(_right_match(glob)))
