"""Personal data in texts, with DataFrame expressions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges
for addresses, digit counts for phones), and words nearby adjust the score.  A kind whose pattern
alone says little (social security numbers) needs such words.

The patterns run once over a text to see whether it has any hit, and only then to take them.  They
are written so that no text makes them backtrack: a run of characters is entered at its beginning
only and never given back.  Offsets are sums of the lengths of gaps and hits, kept in blocks, so
the cost stays near linear for any number of hits.

Words are looked for in ``CONTEXT`` code points before and after a hit.  Hits of one kind with at most
that much between them, confirmed or not, are a list and share their words, however long it is.

Defined results: a null text is an empty one and has no spans.  Spans of different kinds may
overlap.  Rows may repeat, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT = 48  # code points before and after a hit, and between those of a list
BONUS = 0.35
LEAST_SCORE = 0.5


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """Of a string of digits: every second from the right is doubled, its digits summed."""

    def add(total: Column, digit: Column, i: Column) -> Column:
        twice = digit * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    numbered = F.transform(F.reverse(characters(number)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), lambda total, x: add(total, x["d"], x["i"])) % 10 == 0


def mod97(code: Column) -> Column:
    """Of an IBAN without blanks: its number, letters from 10 on, is 1 modulo 97."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)

    return F.aggregate(characters(turned), F.lit(0), step) == 1


def octets(address: Column) -> Column:
    """All parts at most 255, however many zeros lead them."""
    bare = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def between(text: Column, least: int, most: int) -> Column:
    return F.length(digits(text)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """``base`` spans are never dropped; the others need ``LEAST_SCORE``."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", octets, 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
         lambda m: between(m, 14, 19) & luhn(digits(m)), 0.8, "card|credit|visa|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: between(m, 10, 15), 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
         lambda m: mod97(F.translate(m, " ", "")), 0.9, "iban|account|bank|konto", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"\bssns?\b|social security", base=False),
)
_HIT = "struct<at:int,text:string>"
_STATE = f"struct<at:int,done:array<array<{_HIT}>>,block:array<{_HIT}>>"


def located(gaps: Column, texts: Column) -> Column:
    """Offset and text of each hit, in order."""
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(texts)), texts, lambda g, t: F.struct(g.alias("g"), t.alias("t")))
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast(f"array<array<{_HIT}>>").alias("done"), F.array().cast(f"array<{_HIT}>").alias("block")
    ).cast(_STATE)

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["g"])
        hit = F.struct(at.alias("at"), p["t"].alias("text"))
        return F.struct((at + F.length(p["t"])).alias("at"), s["done"].alias("done"), F.concat(s["block"], F.array(hit)).alias("block"))

    def close(s: Column) -> Column:
        return F.struct(s["at"].alias("at"), F.concat(s["done"], F.array(s["block"])).alias("done"), F.array().cast(f"array<{_HIT}>").alias("block"))

    blocks = F.transform(F.sequence(F.lit(1), F.size(texts), F.lit(BLOCK)), lambda i: F.slice(pairs, i, F.lit(BLOCK)))
    return F.flatten(F.aggregate(blocks, zero, lambda s, b: F.aggregate(b, s, step, close), lambda s: s["done"]))


def carried(sides: Column) -> Column:
    """Of structs ``said``, ``close``: whether it or one before, with only close ones from there on, has said it."""
    zero = F.struct(F.lit(False).alias("on"), F.array().cast("array<array<boolean>>").alias("done"), F.array().cast("array<boolean>").alias("block"))

    def step(s: Column, side: Column) -> Column:
        on = side["said"] | (side["close"] & s["on"])
        return F.struct(on.alias("on"), s["done"].alias("done"), F.concat(s["block"], F.array(on)).alias("block"))

    def close(s: Column) -> Column:
        return F.struct(s["on"].alias("on"), F.concat(s["done"], F.array(s["block"])).alias("done"), F.array().cast("array<boolean>").alias("block"))

    blocks = F.transform(F.sequence(F.lit(1), F.size(sides), F.lit(BLOCK)), lambda i: F.slice(sides, i, F.lit(BLOCK)))
    return F.flatten(F.aggregate(blocks, zero, lambda s, b: F.aggregate(b, s, step, close), lambda s: s["done"]))


def told(gaps: Column, words: str) -> Column:
    """Whether the words stand near each hit or near its list; ``gaps`` has one more than there are hits."""

    def side(cut: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        return lambda g: F.struct(
            F.lower(cut(g, F.lit(CONTEXT))).rlike(words).alias("said"), (F.length(g) <= CONTEXT).alias("close")
        )

    def both(g: Column) -> Column:
        n = F.size(g) - 1
        before = carried(F.transform(F.slice(g, F.lit(1), n), side(F.right)))
        after = F.reverse(carried(F.transform(F.reverse(F.slice(g, F.lit(2), n)), side(F.left))))
        return F.zip_with(before, after, lambda a, b: a | b)

    return F.transform(F.array(gaps), both)[0]  # both ways read one split


def hits(text: Column, kind: Kind) -> Column:
    """Array of confirmed spans of one kind: start, rank, end, kind, score, base."""
    pattern = F.lit(kind.pattern)
    gaps = F.split(text, kind.pattern, -1)
    found = F.zip_with(
        located(gaps, F.regexp_extract_all(text, pattern, F.lit(0))), told(gaps, kind.words),
        lambda h, near: F.struct(h["at"].alias("at"), h["text"].alias("text"), near.alias("near")),
    )
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)

    def span(h: Column) -> Column:
        bonus = F.when(h["near"], F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            h["at"].alias("start"), F.lit(rank).alias("rank"), (h["at"] + F.length(h["text"])).alias("end"), F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(kind.score) + bonus).alias("score"), F.lit(kind.base).alias("base"),
        )

    spans = F.transform(F.filter(found, lambda h: kind.valid(h["text"])), span)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>>")
    return F.when(text.rlike(kind.pattern), F.filter(spans, lambda s: s["base"] | (s["score"] >= LEAST_SCORE))).otherwise(none)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``id_col`` and ``spans``: kind, code-point offsets, score and base, by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col), *[hits(text, k).alias(f"_{i}") for i, k in enumerate(kinds)])
    return found.select(id_col, F.array_sort(F.concat(*[F.col(f"_{i}") for i in range(len(kinds))])).alias("spans"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, digest of the base spans, all spans as one string."""
    base = F.filter("spans", lambda s: s["base"])
    names = [k.name for k in KINDS if k.base]

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == name))).cast("bigint").alias(f"n_{name}")

    return found.select(
        id_col, *[count(n) for n in names], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
