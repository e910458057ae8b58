"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after every blank, tab and line character is deleted.
Three combining steps, each of which groups by the digest *and* the whole normalised text, so
that texts with the same digest but different content never merge:

1. local: Spark's partial aggregation folds the copies inside each task before anything moves;
2. salted: what is left of a digest is dealt over ``salts`` groups, so that a text with any share
   of the rows is folded by many tasks;
3. global: the salt winners of a digest, at most ``salts`` for each text, give the final winner.

Every document is then told its winner over its digest.  A digest that stands for several texts
(never seen with SHA-256, forced in the tests) is told apart by the text itself.

Defined results: a null text counts as empty, and all empty texts are equal.  Rows with a null id
are documents too; they win only where no equal text of the same length has an id.  Rows that
repeat an id and a text all report the same winner and all count in ``group_size``.  An empty
table gives an empty result.  Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.llm.storage import stored, unused
from leakframe.session import small_side

BLANKS = " \t\n\x0b\x0c\r"
SALTS = 16
# above any difference of two ids, so that length and id fit one exact decimal
_SPAN = "20000000000000000000"
_NO_ID = "9900000000000000000"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _wide(value) -> Column:
    return F.lit(value).cast("decimal(38,0)") if isinstance(value, str) else value.cast("decimal(38,0)")


def winners(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per distinct text: digest, content, winner's id, number of rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = _wide(F.char_length(text))
    number = F.coalesce(_wide(F.col(id_col)), _wide(_NO_ID))
    rows = docs.select(
        normalised(F.col(text_col)).alias("content"),
        length.alias("length"), (length * _wide(_SPAN) - number).cast("decimal(38,0)").alias("rank"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("salt"),
    ).withColumn("digest", digest(F.col("content")))
    # longest first, then the smallest id: one number, so that both steps stay hash aggregations
    best = [F.max("rank").alias("rank"), F.max("length").alias("length")]
    salted = rows.groupBy("digest", "salt", "content").agg(*best, F.count(F.lit(1)).alias("n"))
    found = salted.groupBy("digest", "content").agg(*best, F.sum("n").alias("n"))
    winner = (F.col("length") * _wide(_SPAN) - F.col("rank")).cast("decimal(38,0)")
    return found.select(
        "digest", "content", F.when(winner < _wide(_NO_ID), winner.cast("bigint")).alias("keep_id"),
        F.col("n").alias("group_size"),
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256, several: bool | None = None,
) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row.

    ``several`` says that one digest may stand for different texts; then each document compares
    its text with those of its digest.  By default that holds for any digest but SHA-256, where
    the aggregation over whole texts has to be trusted to yield one text per digest: it raises if
    it ever does not.
    """
    several = digest is not sha256 if several is None else several
    won = winners(docs, id_col, text_col, salts, digest)
    content = normalised(F.col(text_col))
    own = docs.select(
        F.col(id_col), digest(content).alias("_digest"), sha256(content).alias("text_sha256"),
        *([content.alias("_content")] if several else []),
    )
    if several:
        joined = own.join(won, (F.col("_digest") == won.digest) & (F.col("_content") == won.content))
    else:
        one = F.when(F.count(F.lit(1)) == 1, F.max("group_size"))
        single = won.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"),
            F.coalesce(one, F.raise_error(F.lit("one digest, two texts: use several=True")).cast("bigint")).alias("group_size"),
        )
        # a table of its own, so that both sides of the join are plain shuffles and a digest with
        # any share of the rows can be split
        joined = own.join(stored(single, "winners"), F.col("_digest") == F.col("digest"))
    return joined.select(
        F.col(id_col), "keep_id", F.col("group_size").cast("bigint"),
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns; one row for each distinct text.

    What goes, and the rare rows that repeat an id together with its text, are named by id and
    digest; they are few, so the texts need no shuffle unless that list is measured to be large.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    id_, digest, kept, sum_ = unused(docs, "_id", "_digest", "_kept", "_sum")
    odd = groups.groupBy(F.col(id_col).alias(id_), F.col("text_sha256").alias(digest)).agg(
        F.bool_or("kept").alias(kept), F.count(F.lit(1)).alias("rows")
    ).where(~F.col(kept) | (F.col("rows") > 1)).select(id_, digest, kept)
    odd = small_side(odd)
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (sha256(normalised(F.col(text_col))) == F.col(digest))
    stay = docs.join(odd, same, "left_anti")
    # one row of those that repeat; the table of the others is the same one, filtered
    again = docs.join(odd.where(kept), same, "left_semi").withColumn(sum_, sha256(normalised(F.col(text_col))))
    return stay.unionByName(again.dropDuplicates([id_col, sum_]).drop(sum_))
