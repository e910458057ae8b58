"""Shards by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards, each shard with a weight; the weight of a rack or region is
the sum below it.  A document descends from the root: at each level every child draws a number for
the document's key, ln(u) / weight with u hashed from the key and the child's name, and the greatest
draw wins.  A child is chosen in proportion to its weight, by the key alone, and no table of places
is kept.

A draw depends on its own child only.  A changed weight moves documents between that child and its
siblings, at the levels above likewise, and nowhere else: below siblings whose weights stay, all
draws stay.  A shard that opens a region of its own (``with_region``) changes no other weight at
all, so documents move only into it.

Keys are the ids as text, so rows that repeat an id share its shard, and all null ids share one (the
place of the empty string).  However full a shard gets, its rows are numbered over ranges, not in one
task: equal rows are told apart by a number given when the narrow rows are stored.  Texts are
read once, and only their sizes and checksums go on.

Defined results: a null text has no bytes and the checksum of nothing, 0.  Children of weight 0
get nothing; a tree without weight is refused.  An empty table gives an empty result.  Other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakframe.functions.regex import let
from leakframe.llm.storage import stored
from leakframe.operators.ranking import number_within

REGIONS, RACKS, SHARDS = 2, 3, 4  # 24 shards


@dataclass(frozen=True)
class Node:
    """A region or rack with ``children``, or a shard with its number."""

    name: str
    weight: float = 0.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    def __post_init__(self) -> None:
        if self.children:
            object.__setattr__(self, "weight", sum(c.weight for c in self.children))

    def changed(self, path: str, weight: float) -> Node:
        """The tree with another weight for the shard at ``path`` (names joined by ``/``)."""
        name, _, rest = path.partition("/")
        found = [c for c in self.children if c.name == name]
        if not found:
            raise ValueError(f"no {name} below {self.name}")
        new = found[0].changed(rest, weight) if rest else replace(found[0], weight=float(weight))
        return replace(self, children=tuple(new if c.name == name else c for c in self.children))

    def shards(self) -> int:
        return sum(c.shards() for c in self.children) if self.children else 1

    def depth(self) -> int:
        return 1 + max(c.depth() for c in self.children) if self.children else 0


def tree(regions: int = REGIONS, racks: int = RACKS, shards: int = SHARDS, weight: float = 1.0) -> Node:
    """Shards numbered from 0 in racks and regions of equal shape."""
    number = iter(range(regions * racks * shards))
    return Node("", children=tuple(
        Node(f"region{r}", children=tuple(
            Node(f"rack{k}", children=tuple(Node(f"shard{s}", weight, shard=next(number)) for s in range(shards))) for k in range(racks)
        )) for r in range(regions)
    ))


def with_region(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region and a rack of its own."""
    shard = Node("shard0", weight, shard=root.shards())
    region = Node(f"region{len(root.children)}", children=(Node("rack0", children=(shard,)),))
    return replace(root, children=(*root.children, region))


def _table(root: Node) -> tuple[list[list[tuple[str, float, int]]], list[int | None]]:
    """By node number, the root first: its children with a weight as (path, weight, number), and its
    shard."""
    children: list[list[tuple[str, float, int]]] = [[]]
    shards: list[int | None] = [root.shard]
    waiting = [("", root, 0)]
    for path, node, at in waiting:
        for child in node.children:
            if child.weight > 0:
                children[at].append((f"{path}/{child.name}", float(child.weight), len(children)))
                waiting.append((f"{path}/{child.name}", child, len(children)))
                children.append([])
                shards.append(child.shard)
        if node.children and not children[at]:
            raise ValueError(f"nothing below {path or 'the root'} has a weight")
    return children, shards


def choose(key: Column, root: Node) -> Column:
    """Number of the shard that ``key`` reaches.  The tree is one literal, looked up by node, so the
    expression grows with its depth only."""
    children, shards = _table(root)
    none = F.array().cast("array<struct<path:string,weight:double,node:int>>")
    table = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(n).alias("node")) for p, w, n in c]) if c else none for c in children])

    def down(node: Column) -> Column:
        def won(below: Column) -> Column:
            draws = F.transform(below, lambda c: F.struct(F.log(_uniform(c["path"], key)) / c["weight"], c["node"].alias("node")))
            return F.when(F.size(below) == 0, node).otherwise(F.array_max(draws)["node"])

        return let(F.get(table, node), won)

    node = F.lit(0)
    for _ in range(root.depth()):
        node = let(node, down)
    return F.get(F.array(*[F.lit(s).cast("int") for s in shards]), node)


def _uniform(path: Column, key: Column) -> Column:
    """A number in (0, 1) with 52 random bits of the MD5 of path and key."""
    number = F.conv(F.substring(F.md5(F.concat(path, F.lit(":"), key).cast("binary")), 1, 13), 16, 10)
    return (number.cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def assign(docs: DataFrame, root: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``shard``, ``slot`` (0, 1, ... in the
    shard, by id) and ``grown_shard``: the place in the ``grown`` tree, null without one."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    moved = F.lit(None).cast("int") if grown is None else choose(key, grown)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
        choose(key, root).cast("int").alias("shard"), moved.cast("int").alias("grown_shard"),
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    order = [F.asc_nulls_first("id"), F.asc("text_crc32"), F.asc("size"), F.asc("row")]
    placed = number_within(rows, ["shard"], order, "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, root: Node, path: str, id_col: str = "doc_id", files: int | None = None) -> None:
    """Whole rows as Parquet below ``path/shard=N``.  Ranges over (shard, id) deal the rows to
    tasks, so a full shard is written by many tasks, in files sorted by id."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.withColumn("shard", choose(key, root).cast("int"))
    order = ["shard", F.asc_nulls_first(id_col), F.xxhash64(*[F.col(c) for c in rows.columns if c != "shard"])]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions("shard", F.asc_nulls_first(id_col)).write.partitionBy("shard").parquet(path)
