"""LIKE joins through an index of literal pieces.

A LIKE pattern that begins with a wildcard has no prefix to join on, and testing every pattern on
every text would be a product.  Texts are indexed instead by their distinct pieces of one to three
characters.  A pattern requires all pieces of its literal parts; it joins on the one that the fewest
texts hold, and LIKE decides on those.  A pattern with a piece that no text holds matches nothing
and joins nothing.  Patterns of wildcards alone ask for a length only: they join on lengths, of which
there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.functions.regex import let
from leakframe.session import cut_lineage

PIECE = 3


def pieces(value: Column, longest: int = PIECE) -> Column:
    """Distinct pieces of one to ``longest`` characters."""

    def of_size(k: int) -> Column:
        last = F.length(value) - k + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(value, i, F.lit(k))))

    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(of_size(k), empty) for k in range(1, longest + 1)]))


def literal_parts(pattern: Column) -> Column:
    """The parts of a LIKE pattern between its wildcards, without escapes."""
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)(?:\\.|[^%_\\])+"), F.lit(0))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))


def required_pieces(pattern: Column, longest: int = PIECE) -> Column:
    return F.array_distinct(F.flatten(F.transform(literal_parts(pattern), lambda p: pieces(p, longest))))


def like_join(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str, longest: int = PIECE) -> DataFrame:
    """``texts`` with the ``patterns`` that they match, as ``text LIKE pattern``.

    Both sides keep their columns, whose names must differ.  Null texts and patterns match nothing.
    Texts should be distinct (fold them first): the index has a row for each piece of a text, and
    a piece that many texts hold is a skewed join key that AQE splits.
    """
    own = texts.where(F.col(text_col).isNotNull())
    asked = cut_lineage(
        patterns.where(F.col(pattern_col).isNotNull()).withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_pieces", required_pieces(F.col(pattern_col), longest))
    )
    wanted = asked.select("_id", F.explode("_pieces").alias("_piece"), F.size("_pieces").alias("_of"))
    # only pieces that some pattern asks for enter the index
    index = own.select(*texts.columns, F.explode(let(F.col(text_col), lambda t: pieces(t, longest))).alias("_piece"))
    held = index.join(wanted.select("_piece").distinct(), "_piece", "left_semi").groupBy("_piece").agg(F.count(F.lit(1)).alias("_held"))
    rarest = wanted.join(held, "_piece").groupBy("_id").agg(
        F.min(F.struct("_held", (-F.length("_piece")).alias("_size"), "_piece")).alias("_best"), F.count(F.lit(1)).alias("_found"), F.first("_of").alias("_of")
    ).where("_found = _of").select("_id", F.col("_best._piece").alias("_piece"))
    keyed = asked.join(rarest, "_id").select(*patterns.columns, "_piece")
    like = F.expr(f"`{text_col}` LIKE `{pattern_col}`")
    matched = index.join(keyed, "_piece").where(like).select(*texts.columns, *patterns.columns)

    # wildcards alone: at least as many characters as there are _, and exactly as many without %
    bare = asked.where(F.size("_pieces") == 0)
    least = F.length(F.regexp_replace(pattern_col, "%", ""))
    longest_text = own.agg(F.max(F.length(text_col))).first()[0] or 0
    bare = bare.withColumn("_least", least)
    ends = F.when(F.col(pattern_col).contains("%"), F.lit(longest_text)).otherwise(F.col("_least"))
    lengths = bare.where(F.col("_least") <= ends).select(*patterns.columns, F.explode(F.sequence("_least", ends)).alias("_length"))
    by_length = own.withColumn("_length", F.length(text_col)).join(lengths, "_length").select(*texts.columns, *patterns.columns)
    return matched.unionByName(by_length)
