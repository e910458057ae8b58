"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.llm import chat, embeddings, exact, hash_tree, language, minhash, mixing, packing, periodic, pii, token_store, url_tree, whitening
from leakframe.llm.storage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _url_sql() -> str:
    """Rules, then the tree level by level."""
    steps, above = [], "host"
    for i in (1, 2, 3):
        own, whole = f"sum(n) OVER (PARTITION BY {above}, s{i})", f"sum(n) OVER (PARTITION BY {above})"
        steps.append(
            f"b{i} AS (SELECT *, CASE WHEN s{i} = '$' OR ({own} >= 3 AND {own} >= 0.02::DOUBLE * {whole}) THEN s{i} ELSE '*' END AS t{i} "
            f"FROM {'a' if i == 1 else f'b{i - 1}'})"
        )
        above += f", t{i}"
    steps.append("c0 AS (SELECT host, t1, t2, t3, sum(good) AS good, sum(bad) AS bad, '' AS branch FROM b3 GROUP BY host, t1, t2, t3)")
    for i in (1, 2, 3):
        steps.append(f"""n{i}_0 AS (SELECT host, branch, t{i}, sum(good) AS g, sum(bad) AS b, CASE WHEN sum(good) + sum(bad) > 0 THEN '' ELSE 'none' END AS grp FROM c{i - 1} GROUP BY host, branch, t{i})""")
        for r in range(1, url_tree.ROUNDS + 1):
            steps.append(f"""o{i}_{r} AS (SELECT *, (g + b + 2)::DOUBLE AS m, (g + 1)::DOUBLE / (g + b + 2)::DOUBLE AS p, sum(g) OVER w - g AS og, sum(b) OVER w - b AS ob
  FROM n{i}_{r - 1} WINDOW w AS (PARTITION BY host, branch, grp)),
p{i}_{r} AS (SELECT *, (og + ob + 2)::DOUBLE AS k, (og + 1)::DOUBLE / (og + ob + 2)::DOUBLE AS q FROM o{i}_{r}),
q{i}_{r} AS (SELECT *, (p * m + q * k) / (m + k) AS pooled FROM p{i}_{r}),
n{i}_{r} AS (SELECT host, branch, t{i}, g, b, CASE WHEN grp = 'none' THEN grp WHEN NOT (p - q) * (p - q) > 1.64::DOUBLE * 1.64::DOUBLE * pooled * (1 - pooled) * (1 / m + 1 / k) THEN grp || '='
  WHEN p < q THEN grp || '-' ELSE grp || '+' END AS grp FROM q{i}_{r})""")
        steps.append(f"""c{i} AS (SELECT c.* EXCLUDE (branch), c.branch || '/' || n.grp AS branch FROM c{i - 1} c JOIN n{i}_{url_tree.ROUNDS} n ON c.host = n.host AND c.branch = n.branch AND c.t{i} = n.t{i})""")
    cases = "".join(
        f" WHEN (s.host = '{n.partition('/')[0]}' OR ends_with(s.host, '.{n.partition('/')[0]}')) AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n}'"
        for n, _ in sorted(URL_RULES, key=lambda r: -len(r[0]))
    )
    says = "".join(f" WHEN '{n}' THEN '{v}'" for n, v in URL_RULES)
    return rf"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_tree.UPPER}', '{url_tree.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), l AS (
  SELECT doc_id, count(*) FILTER (quality = 1 AND toxic = 0) AS good, count(*) FILTER (NOT (quality = 1 AND toxic = 0)) AS bad
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), r AS (
  SELECT h.*, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
                        lambda x: regexp_replace(regexp_replace(x, '^[0-9a-f-]{{16,}}\z', '{{x}}'), '[0-9]+', '{{n}}', 'g')) AS m
  FROM h LEFT JOIN l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]+)[^/]*\z', 1) AS BIGINT)
), s AS (
  SELECT *, coalesce(m[1], '$') AS s1, coalesce(m[2], '$') AS s2, coalesce(m[3], '$') AS s3,
         CASE WHEN len(m) > 3 THEN '**' || array_to_string(m[4:], '/') ELSE '$' END AS s4 FROM r
), a AS (SELECT host, s1, s2, s3, s4, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM s GROUP BY host, s1, s2, s3, s4),
{", ".join(steps)},
e AS (SELECT (sum(good) + 1)::DOUBLE / (sum(good) + sum(bad) + 1)::DOUBLE AS e FROM c3),
u AS (SELECT host, (sum(good) + 10.0::DOUBLE * any_value(e)) / (sum(good) + sum(bad) + 10.0::DOUBLE) AS hp FROM c3, e GROUP BY host),
v AS (SELECT c3.host, branch, (sum(good) + 10.0::DOUBLE * any_value(hp)) / (sum(good) + sum(bad) + 10.0::DOUBLE) AS purity FROM c3 JOIN u ON u.host = c3.host GROUP BY c3.host, branch),
x AS (SELECT c3.host, t1, t2, t3, purity FROM c3 JOIN v ON v.host = c3.host AND v.branch = c3.branch),
y AS (SELECT b3.host, s1, s2, s3, s4, purity FROM b3 JOIN x ON x.host = b3.host AND x.t1 = b3.t1 AND x.t2 = b3.t2 AND x.t3 = b3.t3),
z AS (SELECT page_id, s.host, path, CASE{cases} END AS rule, purity
  FROM s JOIN y ON y.host = s.host AND y.s1 = s.s1 AND y.s2 = s.s2 AND y.s3 = s.s3 AND y.s4 = s.s4)
SELECT page_id, host, path, rule, coalesce(CASE rule{says} END, CASE WHEN purity < 0.6::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM z
"""


@query(_url_sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document whose number ends its path: good if of high quality and
    not toxic."""
    _, path = url_tree.split_url(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(path, r"/([0-9]+)[^/]*\z", 1).try_cast("bigint").alias("doc"))
    fine = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(
        F.count_if(fine).alias("good"), F.count_if(~fine).alias("bad")
    )
    judged = url_tree.judge_urls(pages.join(labels, "doc", "left"), URL_RULES, good_col="good", bad_col="bad")
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
""")
def op2_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, folder)

_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", """len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN d[len(d) - i + 1]::INT WHEN d[len(d) - i + 1]::INT > 4 THEN 2 * d[len(d) - i + 1]::INT - 9 ELSE 2 * d[len(d) - i + 1]::INT END)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 10 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", """list_reduce(
        list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: ascii(c)::BIGINT)),
        lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END) = 1"""),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(right(gap, 48)), '\bssn\b|social security')"),
}


def _pii_sql() -> str:
    ctes = []
    for rank, (kind, (pattern, valid)) in enumerate(_SQL_KINDS.items()):
        ctes.append(f"""{kind}_a AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS ms FROM t WHERE regexp_matches(t, '{pattern}')),
{kind}_b AS (SELECT doc_id, i, ms[i] AS m, gaps[i] AS gap, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, gaps, ms FROM {kind}_a, unnest(range(1, len(ms) + 1)) AS u(i)),
{kind} AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, len(m) AS size,
  list_sum(list_transform(gaps[:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x))), 0)::BIGINT AS start FROM {kind}_b WHERE {valid})""")
    every = " UNION ALL ".join(f"SELECT * FROM {k}" for k in _SQL_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in list(_SQL_KINDS)[:4])
    said = "kind || ':' || start || ':' || (start + size)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(ctes)}, s AS ({every})
SELECT t.doc_id, {counts}, sha256(coalesce(string_agg({said}, ',' ORDER BY start, rank) FILTER (rank < 4), '')) AS base_sha256,
       coalesce(string_agg({said}, ',' ORDER BY start, rank), '') AS spans
FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id"""


@query(_pii_sql())
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~out))
    return language.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")

@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, replace(replace(role, '~', '~~'), chr(10), '~n') AS r, '[<\[]~*(/?s>|/?INST\]|\|)' AS control FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(3 + length(r) + len(regexp_extract_all(r, control)) + 1 + length(text) + len(regexp_extract_all(text, control)) + 5)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
""")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = turns.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    return chat.read_back(chat.format_turns(turns)).drop("n_attachments", "attachment_tokens")


@query(r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS place FROM s
), r AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM c
), f AS (SELECT place AS free_at, rest AS free_rest, w_rest AS free_w FROM r WHERE cap * w_rest > w * rest ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN place >= free_at THEN (w * free_rest) / free_w ELSE cap END AS target
  FROM r LEFT JOIN f ON true
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t
), z AS (
  SELECT d.source, d.size, target - certain * source_size AS rest, count(*) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE d.size > 0 GROUP BY ALL
), y AS (
  SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c FROM z
), k AS (SELECT source, arg_max(c, size) AS c FROM y WHERE c * size < 1 GROUP BY source),
q AS (
  SELECT d.doc_id, d.size, g.*, target - certain * source_size AS left_words, k.c * d.size AS f,
         (('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
), o AS (
  SELECT *, CASE WHEN size > 0 AND f >= 1 THEN 0 WHEN f > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (f / (1.0::DOUBLE - f)) END AS quotient FROM q
), n AS (
  SELECT *, sum(CASE WHEN quotient IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY quotient NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS words FROM o
)
SELECT doc_id, size, source_size, target,
       ((certain + CASE WHEN quotient IS NOT NULL AND 2 * words - size <= 2 * left_words THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM n
""")
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query(r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
""")
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
rare AS (SELECT x.doc_id, x.g, row_number() OVER (PARTITION BY x.doc_id ORDER BY c, x.g) AS r FROM x JOIN (SELECT g, count(*) AS c FROM x GROUP BY g) USING (g)),
prefix AS (SELECT r.doc_id, r.g, n.n FROM rare r JOIN n USING (doc_id) WHERE r.r <= n.n - ceil(0.85 * n.n) + 1),
candidates AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b
  ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
),
inter AS (SELECT c.a, c.b, count(*) AS i FROM candidates c JOIN x p ON p.doc_id = c.a JOIN x q ON q.doc_id = c.b AND q.g = p.g GROUP BY c.a, c.b),
links AS (
  SELECT i.a, i.b FROM inter i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * i.i >= 85 * (na.n + nb.n - i.i)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
""")
def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_hash")


@query()
def op10_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def _draws(path: str, weights: list[float]) -> str:
    """The child below ``path`` with the greatest draw."""
    u = f"((('0x' || substr(md5('{path}' || c || ':' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
    return f"list_sort(list_transform(range({len(weights)}), lambda c: {{'v': ln({u}) / {weights}[c + 1], 'c': c}}))[-1].c"


def _tree_sql() -> str:
    """Regions of 12, racks of 4; the grown tree has a third region with one shard."""
    size = hash_tree.RACKS * hash_tree.SHARDS
    whole = [float(size)] * hash_tree.REGIONS

    def below(region: str) -> tuple[str, str]:
        path = f"/region' || {region} || '/rack"
        rack = _draws(path, [float(hash_tree.SHARDS)] * hash_tree.RACKS)
        shard = _draws(f"/region' || {region} || '/rack' || r.rack || '/shard", [1.0] * hash_tree.SHARDS)
        return rack, shard

    rack, shard = below("region")
    rack2, shard2 = below("grown")
    shard2 = shard2.replace("r.rack", "r.rack2")
    remainders = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"
    # the UTF-8 bytes of a text, from its code points
    tail = "128 + (o >> {0}) % 64"
    utf8 = (
        "flatten(list_transform(string_split(coalesce(text, ''), ''), lambda x: list_transform([unicode(x)::BIGINT], lambda o: CASE WHEN o < 128 THEN [o] "
        f"WHEN o < 2048 THEN [192 + (o >> 6), {tail.format(0)}] WHEN o < 65536 THEN [224 + (o >> 12), {tail.format(6)}, {tail.format(0)}] "
        f"ELSE [240 + (o >> 18), {tail.format(12)}, {tail.format(6)}, {tail.format(0)}] END)[1]))"
    )
    return f"""
WITH t AS MATERIALIZED (SELECT {remainders} AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, key, strlen(text)::BIGINT + 8 AS size, CASE WHEN text = '' THEN [] ELSE {utf8} END AS bytes FROM d),
c AS (SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda r, x: xor(r >> 8, t[xor(r % 256, x) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, t),
g AS (SELECT *, {_draws("/region", whole)} AS region, {_draws("/region", whole + [1.0])} AS grown FROM c),
r AS (SELECT *, {rack} AS rack, {rack2} AS rack2 FROM g),
s AS (SELECT *, (region * {size} + rack * {hash_tree.SHARDS} + {shard})::INT AS shard,
  (CASE WHEN grown = {hash_tree.REGIONS} THEN {size * hash_tree.REGIONS} ELSE grown * {size} + rack2 * {hash_tree.SHARDS} + {shard2} END)::INT AS grown_shard FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size)::BIGINT - 1 AS slot, grown_shard FROM s
"""


@query(_tree_sql())
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions of three racks of four shards; the 25th shard opens a region of its own."""
    root = hash_tree.tree()
    placed = hash_tree.assign(table(spark, sf_dir, "documents"), root, hash_tree.with_region(root))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.collapse_runs(docs)
    found = found.withColumn("best", periodic.best_run(F.col("runs")))
    said = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(said.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
