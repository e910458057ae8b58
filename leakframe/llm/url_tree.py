"""URL filter by a path-template tree, with DataFrame operations only.

Rules decide first: the longest that fits a url.  For the others each host has a tree of path
templates, learned from all urls:

1. digits and long hexadecimal words in a segment are masked, and urls are counted by host and
   masked path (a partial aggregation, so a host with any share of the urls is no hot key);
2. going down, a segment stays literal where it holds at least ``MIN_SHARE`` of the urls below its
   parent, or has ``KEEP_LABELS`` labels that can be told apart from its parent's, and becomes a
   wildcard elsewhere;
3. going down again, siblings whose labels cannot be told apart from those of the others of their
   group by a two-proportion test become one branch, so that their children pool their labels;
4. a template is rejected if its purity, the share of good labels smoothed towards its host, which
   is smoothed towards all hosts, is below ``MIN_PURITY``.

Trees go down ``LEVELS`` segments everywhere, and on, segment by segment, in each branch that has
labels and urls that still differ, until none is left.  A template names the segments down to there.
A branch without labels has the purity of its host.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and is
judged by the template of the empty host.  Labels with nulls say nothing.  Rows may repeat, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leakframe.llm.storage import stored

LEVELS = 3  # at least
MIN_SHARE, MIN_COUNT = 0.02, 3
SIMILAR = 1.64  # two proportions closer than this many standard errors are taken for one
KEEP_LABELS = 30
ROUNDS = 3  # in which a group of siblings may part
PRIOR = 10.0
MIN_PURITY = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"  # no more segments


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    mark = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        own_host, _, own_path = name.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def masked(path: Column) -> Column:
    """The path of masked segments, without empty ones."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-f-]{16,}\z", "{x}"), "[0-9]+", "{n}")), "/")


def told_apart(p: Column, m: Column, q: Column, k: Column) -> Column:
    """The proportions ``p`` of ``m`` and ``q`` of ``k`` differ."""
    pooled = (p * m + q * k) / (m + k)
    return (p - q) * (p - q) > SIMILAR * SIMILAR * pooled * (F.lit(1.0) - pooled) * (1 / m + 1 / k)


def with_proportion(df: DataFrame, p: str = "p", m: str = "m") -> DataFrame:
    return df.withColumn(m, F.col("g") + F.col("b") + 2).withColumn(p, (F.col("g") + 1) / F.col(m)).drop("g", "b")


def generalised(tree: DataFrame, level: int) -> DataFrame:
    """Takes the next segment off ``rest`` and adds it, or a wildcard, to ``template``; ``t`` is what it adds."""
    s = F.when(F.col("rest") == "", F.lit(END)).otherwise(F.substring_index("rest", "/", 1))
    tree = tree.withColumn("s", s).withColumn("rest", F.substring("rest", F.length("s") + 2, F.length("rest")))
    above = ["host", "template"]
    sums = [F.sum("good").alias("g"), F.sum("bad").alias("b")]
    own = with_proportion(tree.groupBy(*above, "s").agg(F.sum("n").alias("_n"), *sums))
    whole = with_proportion(tree.groupBy(*above).agg(F.sum("n").alias("_all"), *sums), "q", "k")
    large = (F.col("_n") >= MIN_COUNT) & (F.col("_n") >= MIN_SHARE * F.col("_all"))
    own_way = (F.col("m") - 2 >= KEEP_LABELS) & told_apart(F.col("p"), F.col("m"), F.col("q"), F.col("k"))
    literal = (F.col("s") == END) | large | own_way
    named = own.join(whole, above).select(*above, "s", F.when(literal, F.col("s")).otherwise(F.lit("*")).alias("t"))
    tree = tree.join(named, [*above, "s"]).drop("s")
    return stored(tree.withColumn("template", F.concat("template", F.lit("/"), "t")), f"tree{level}")


def merged(tree: DataFrame, level: int) -> DataFrame:
    """Takes ``t`` into ``branch``, the merged template.

    The siblings of a node begin as one group.  In each of ``ROUNDS`` rounds every sibling is compared with
    the others of its group together, and those that can be told apart from them leave it, the worse
    and the better ones into groups of their own.  So a group holds siblings that are alike, however
    many there are between its purest and its least pure one.  Siblings without labels are one group.

    Siblings with equal counts of labels are one row of the windows, which see no urls and no names.
    """
    node = ["host", "branch"]
    nodes = tree.groupBy(*node, "t").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    values = nodes.groupBy(*node, "g", "b").agg(F.count(F.lit(1)).alias("alike")).repartition(*node)
    values = values.withColumn("group", F.when(F.col("g") + F.col("b") > 0, F.lit("")).otherwise(F.lit("none")))
    for _ in range(ROUNDS):
        inside = Window.partitionBy(*node, "group")
        others = lambda c: (F.sum(F.col(c) * F.col("alike")).over(inside) - F.col(c)).alias(f"other_{c}")
        values = values.select(*node, "g", "b", "alike", "group", others("g"), others("b"))
        m, k = F.col("g") + F.col("b") + 2, F.col("other_g") + F.col("other_b") + 2
        p, q = (F.col("g") + 1) / m, (F.col("other_g") + 1) / k
        side = F.when(~told_apart(p, m, q, k), F.lit("=")).when(p < q, F.lit("-")).otherwise(F.lit("+"))
        values = values.select(*node, "g", "b", "alike", F.when(F.col("group") == "none", F.col("group")).otherwise(F.concat("group", side)).alias("group"))
    group = nodes.join(values, [*node, "g", "b"]).select(*node, "t", F.concat("branch", F.lit("/"), F.col("group")).alias("next"))
    return stored(tree.join(group, [*node, "t"]).drop("branch", "t").withColumnRenamed("next", "branch"), f"branches{level}")


def grown(shapes: DataFrame) -> DataFrame:
    """Adds ``template`` and ``branch`` to shapes (host, shape, n, good, bad).

    From ``LEVELS`` on a branch ends where nothing below could tell its urls apart: all have the same
    rest, or none has a label.  The others go on, so the rounds are as many as the deepest of them needs.
    """
    live = shapes.withColumn("rest", F.col("shape")).withColumn("template", F.lit("")).withColumn("branch", F.lit(""))
    ended, node = [], ["host", "branch"]
    for level in count(1):
        live = merged(generalised(live, level), level)
        if level < LEVELS:
            continue
        parts = (F.min("rest") != F.max("rest")) & (F.sum(F.col("good") + F.col("bad")) > 0)
        going = stored(live.groupBy(*node).agg(parts.alias("_parts")).where("_parts").select(*node), f"going{level}")
        if going.isEmpty():
            break
        ended.append(stored(live.join(going, node, "left_anti"), f"ended{level}"))
        live = live.join(going, node, "left_semi")
    return reduce(DataFrame.unionByName, ended, live)


def purities(found: DataFrame) -> DataFrame:
    """Adds the smoothed ``purity`` of its branch to each shape."""
    everything = found.agg((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 1)).scalar()
    hosts = found.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    hosts = hosts.select("host", ((F.col("g") + PRIOR * everything) / (F.col("g") + F.col("b") + PRIOR)).alias("host_purity"))
    branches = found.groupBy("host", "branch").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).join(hosts, "host")
    branches = branches.select("host", "branch", ((F.col("g") + PRIOR * F.col("host_purity")) / (F.col("g") + F.col("b") + PRIOR)).alias("purity"))
    return found.join(branches, ["host", "branch"])


def judge_urls(
    urls: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    good_col: str | None = None, bad_col: str | None = None, min_purity: float = MIN_PURITY,
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` for every row.

    ``good_col`` and ``bad_col`` count the labels of a url; without them no template is rejected.
    """
    host, path = split_url(F.col(url_col))
    zero = F.lit(0).cast("bigint")
    rows = urls.select(
        F.col(id_col), host.alias("host"), path.alias("path"),
        (F.coalesce(F.col(good_col).cast("bigint"), zero) if good_col else zero).alias("good"),
        (F.coalesce(F.col(bad_col).cast("bigint"), zero) if bad_col else zero).alias("bad"),
    )
    rows = rows.withColumn("shape", masked(F.col("path")))
    shapes = stored(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "shapes")
    judged = purities(grown(shapes)).select("host", "shape", "template", "purity")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(judged, ["host", "shape"]).select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity"
    )
