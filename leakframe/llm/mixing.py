"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times the
words of all documents.  A target stops at ``cap`` times the words of its source; the excess goes
to the others by weight until none is above.  Every document of a source is taken whole as often
as the target allows (certain copies).  The rest of the target is drawn with unequal probabilities:
a document is included in proportion to its size, f = min(1, c size), where c makes the expected
words of the source equal to the rest.  The longest documents may so be certain once more.  Each
document gets the odds of its random number, u / (1 - u), divided by its inclusion odds, f / (1 - f)
times an optional weight; the smallest quotients are taken until the words reach the rest, to the
nearest document.  So the sample has a fixed size in words.

A running total over a source would send it to one task.  Quotients are dealt instead into
``SLOTS`` slots of a source, summed, and only the slot where the total reaches the rest is looked
into, again by slots, and then row by row: a millionth of the source.

Random numbers are a hash of the seed and the id, so reruns agree.

Defined results: a null text has size 0.  Documents of size 0 are never drawn.  Rows with a null id
are drawn by a hash of their source and size.  Rows that repeat an id are drawn one after the other.
A source without words has target 0.  An empty table gives an empty result.  Ties in the quotient go
by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakframe.functions.regex import let
from leakframe.llm.storage import stored, unused
from leakframe.operators.ranking import number_within
from leakframe.session import cut_lineage, small_side

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SLOTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: str, value: Column) -> Column:
    """A number in (0, 1) with 52 random bits of the MD5 of seed and value."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), value).cast("binary")), 1, 13), 16, 10)
    return (number.cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to one row per ``source`` with its ``source_size``.

    One task sorts these rows; there is one for each source, and none for a document.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.lit(float(cap)) * F.col("source_size")
    everything = Window.partitionBy()
    # by rising limit per weight: before the first source that keeps its share, all stop at the limit
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.asc_nulls_last("source"))
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("limit", limit).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    rows = rows.withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("w_rest", F.sum("w").over(after)).withColumn("at", F.row_number().over(rising))
    free = F.when(F.col("limit") * F.col("w_rest") > F.col("w") * F.col("rest"), F.struct("at", "rest", "w_rest"))
    rows = rows.withColumn("free", F.min(free).over(everything))
    part = (F.col("w") * F.col("free.rest")) / F.col("free.w_rest")
    kept = F.when(F.col("at") >= F.col("free.at"), part).otherwise(F.col("limit"))
    return rows.select("source", "source_size", F.when(F.col("free").isNull(), F.col("limit")).otherwise(kept).alias("target"))


def _reached(rows: DataFrame, slot: str, base: str) -> DataFrame:
    """The slot of each source in which the words reach ``rest``, and the words before it."""
    sums = rows.groupBy("source_key", "source", slot).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source_key").orderBy(slot)
    sums = sums.withColumn("end", F.sum("words").over(run) + F.lit(0))
    return sums.where(F.col("end") > F.col("rest")).groupBy("source_key").agg(
        F.min(F.struct(F.col(slot), (F.col("end") - F.col("words")).alias("before"))).alias("x")
    ).select("source_key", F.col(f"x.{slot}").alias(f"{slot}_reached"), F.col("x.before").alias(base))


def _source_key(source: Column) -> Column:
    """A null source is a source: its key cannot be that of any other."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _weight(docs: DataFrame, weight_col: str | None) -> Column:
    return F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(docs[weight_col].cast("double"), F.lit(1.0)), F.lit(1e-9))


def calibrated(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with the factor ``c`` of their source: sizes from 1 / c on are certain, and
    the words expected from all are ``rest``.  It comes from how often each size occurs, which is
    as many rows as there are sizes."""
    sizes = rows.where("size > 0").groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(small_side(goals.select("source_key", "rest")), "source_key")
    falling = Window.partitionBy("source_key").orderBy(F.desc("size"))
    longer = F.coalesce(F.sum(F.col("n") * F.col("size")).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum((F.col("n") * F.col("size")).cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    factor = (F.col("rest") - longer) / squares.cast("double")
    first = sizes.select("source_key", "size", factor.alias("c")).where(F.col("c") * F.col("size") < 1)
    return goals.join(first.groupBy("source_key").agg(F.max_by("c", "size").alias("c")), "source_key", "left")


def _quotient(id_: Column, key: Column, size: Column, weight: Column, c: Column, seed: str) -> Column:
    """The odds of a random number over the inclusion odds.  Documents that cannot be drawn have none."""
    f = c * size
    u = uniform(seed, F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), key, size.cast("string"))))
    quotient = let(u, lambda u: (u / (F.lit(1.0) - u)) / ((f / (F.lit(1.0) - f)) * weight))
    return F.when((size > 0) & (f >= 1), F.lit(0.0)).when((size > 0) & (f > 0), quotient)


def _draw(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, cap: float, seed: str,
    weight_col: str | None, slots: int,
) -> tuple[DataFrame, DataFrame]:
    """Narrow rows with ``id``, ``size``, ``q`` and whether they are ``chosen``; and one row per source."""
    rows = docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), _size(docs[text_col]).alias("size"), _weight(docs, weight_col).alias("weight")
    )
    rows = stored(rows.withColumn("source_key", _source_key(F.col("source"))), "sizes")
    goals = targets(rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")).drop("source_key"), weights, share, cap)
    goals = goals.withColumn("source_key", _source_key(F.col("source"))).drop("source")
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = goals.withColumn("certain", certain).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    goals = cut_lineage(calibrated(rows, goals))
    quotient = _quotient(F.col("id"), F.col("source_key"), F.col("size"), F.col("weight"), F.col("c"), seed)
    # one row per source: broadcast if measured to be small, so that no source is a hot join key
    drawn = rows.join(small_side(goals), "source_key").withColumn("q", quotient)
    place = F.col("q") / (F.lit(1.0) + F.col("q")) * F.lit(float(slots))
    drawn = drawn.withColumn("slot", F.floor(place)).withColumn("fine", F.floor((place - F.floor(place)) * F.lit(float(slots))))
    one = _reached(drawn.where("q IS NOT NULL"), "slot", "base")
    drawn = drawn.join(small_side(one), "source_key", "left")
    inside = drawn.where(F.col("slot") == F.col("slot_reached")).withColumn("rest", F.col("rest") - F.col("base"))
    two = _reached(inside, "fine", "fine_base")
    drawn = drawn.join(small_side(two), "source_key", "left")
    below = F.coalesce(F.col("slot") < F.coalesce("slot_reached", F.lit(slots + 1)), F.lit(False)) | F.coalesce(
        (F.col("slot") == F.col("slot_reached")) & (F.col("fine") < F.col("fine_reached")), F.lit(False)
    )
    edge = F.coalesce((F.col("slot") == F.col("slot_reached")) & (F.col("fine") == F.col("fine_reached")), F.lit(False))
    run = Window.partitionBy("source_key").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("base") + F.col("fine_base") + F.sum("size").over(run)
    last = drawn.where(edge).withColumn("chosen", (2 * words - F.col("size") <= 2 * F.col("rest")).cast("bigint"))
    every = drawn.where(~edge).withColumn("chosen", below.cast("bigint")).unionByName(last)
    return every, goals


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix",
    weight_col: str | None = None, slots: int = SLOTS,
) -> DataFrame:
    """``id_col``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` for every row."""
    every, _ = _draw(docs, id_col, text_col, source_col, weights, share, cap, seed, weight_col, slots)
    copies = F.col("certain") + F.col("chosen")
    return every.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix",
    weight_col: str | None = None, slots: int = SLOTS,
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    A source takes what lies below a cut in the order of quotient and id.  The cuts, one row per
    source, go to the documents, which find their own quotient again: no text is joined or
    shuffled.  Rows that lie together on a cut (repeated or null ids) are told apart by number.
    """
    every, goals = _draw(docs, id_col, text_col, source_col, weights, share, cap, seed, weight_col, slots)
    order = F.struct("q", "id")
    cuts = small_side(every.where("chosen = 1").groupBy("source_key").agg(F.max(order).alias("cut")))
    on_cut = every.join(cuts, "source_key").where(F.col("q").eqNullSafe(F.col("cut.q")) & F.col("id").eqNullSafe(F.col("cut.id")))
    on_cut = on_cut.groupBy("source_key").agg(F.first("cut").alias("cut"), F.count(F.lit(1)).alias("rows"), F.sum("chosen").alias("take"))
    decided = cut_lineage(goals.join(on_cut, "source_key", "left").select("source_key", "certain", "c", "cut", "rows", "take"))
    split = not decided.where("take < rows").isEmpty()

    key, of = unused(docs, "_key", "_of")
    decided = decided.select(F.col("source_key").alias(key), F.struct("certain", "c", "cut", "rows", "take").alias(of))
    source, id_ = _source_key(docs[source_col]), docs[id_col]
    rows = docs.join(small_side(decided), source == F.col(key))
    cut, certain, take, number = (F.col(of)[c] for c in ("cut", "certain", "take", "rows"))
    # words are counted and hashed once a row, whatever reads the quotient
    quotient = let(_size(docs[text_col]), lambda size: _quotient(id_, source, size, _weight(docs, weight_col), F.col(of)["c"], seed))

    def on_it(q: Column) -> Column:
        return F.coalesce((q == cut["q"]) & id_.eqNullSafe(cut["id"]), F.lit(False))

    def copies(q: Column) -> Column:
        before = (q < cut["q"]) | ((q == cut["q"]) & (F.struct(q, id_) <= F.struct(cut["q"], cut["id"])))
        return certain + (F.coalesce(before, F.lit(False)) | on_it(q)).cast("bigint")

    def repeated(n: Column) -> Column:
        return F.explode(let(n, lambda n: F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))))

    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    if not split:
        return rows.select(row, repeated(let(quotient, copies))).select("row.*")
    parted = let(quotient, on_it) & (take < number)
    some = rows.where(parted).select(row, F.col(key).alias("key"), certain.alias("certain"), take.alias("take"), F.xxhash64(docs[text_col]).alias("hash"))
    some = number_within(some, ["key"], ["hash"], "number").select("row", repeated(F.col("certain") + (F.col("number") < F.col("take")).cast("bigint")))
    return rows.where(~parted).select(row, repeated(let(quotient, copies))).unionByName(some).select("row.*")
