"""The registered queries: each applies one operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, cdc_dedup, compression_bands, hash_tree, hnsw, importance, merkle, packing, secret_forest, simhash, token_counts, url_lists, vector_codes
from .common import table, unsigned32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_dedup(table(spark, sf_dir, "embeddings"))


ORACLE["op1_hnsw_near_dedup"] = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS node, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), v AS (
  SELECT * FROM e
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.node AS a, b.node AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.node <> b.node AND list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT node, node FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT r.a, min(e.vec_id) AS component_id FROM r JOIN e ON e.node = r.b GROUP BY r.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, true) AS kept
FROM e JOIN c ON c.a = e.node LEFT JOIN n ON n.a = e.node
"""


def _tokenizer_files():
    """The public tokenizers' folder, given as a path to the operators; a module, so found wherever it is installed."""
    import public_tokenizers

    return public_tokenizers


#: Target proportions of the packing query: 1, 2 and 3 parts in turn over the sources by their numbers. A source that
#: is not named here comes after these.
TARGETS = {f"src{k}": 1.0 + k % 3 for k in range(20)}


@_query
def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizer_files()
    packed = packing.pack(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.PATTERN, weights=TARGETS)
    return packed.select(
        "doc_id", "start", "length", unsigned32(F.crc32("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


@_query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


@_query
def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each secret; its CRC stands for the secret itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = secret_forest.fit(spark, usual=secret_forest.language(docs, table(spark, sf_dir, "labels")))
    found = secret_forest.scan(docs, forest=forest)
    return found.select("doc_id", "start", "length", unsigned32(F.crc32(F.col("secret").cast("binary"))).alias("secret_crc32"), "votes")


@_query
def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(table(spark, sf_dir, "documents"))


def _draw_sql(node: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(key || ':{node}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}"


def _pair_sql(a: str, b: str, weight: int) -> str:
    return f"({_draw_sql(a, weight)} > {_draw_sql(b, weight)})::INT"


#: The tree of two regions, racks and shards each; the ninth shard is a region of weight 1. CRC-32 byte by byte.
ORACLE["op5_hash_tree_sharding"] = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS text_crc32
  FROM documents, crc
), r AS (
  SELECT *, {_pair_sql("r0", "r1", 4)} AS region,
    {_draw_sql("r2", 1)} < least({_draw_sql("r0", 4)}, {_draw_sql("r1", 4)}) AS to_new
  FROM d
), k AS (
  SELECT *, CASE region WHEN 0 THEN {_pair_sql("r0/k0", "r0/k1", 2)} ELSE {_pair_sql("r1/k0", "r1/k1", 2)} END AS rack FROM r
), s AS (
  SELECT *, CASE region * 2 + rack
      WHEN 0 THEN {_pair_sql("r0/k0/s0", "r0/k0/s1", 1)} WHEN 1 THEN 2 + {_pair_sql("r0/k1/s2", "r0/k1/s3", 1)}
      WHEN 2 THEN 4 + {_pair_sql("r1/k0/s4", "r1/k0/s5", 1)} ELSE 6 + {_pair_sql("r1/k1/s6", "r1/k1/s7", 1)} END AS shard
  FROM k
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (CASE WHEN to_new THEN 8 ELSE shard END)::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key), 1, 13))::BIGINT, doc_id, size, text_crc32) - 1 AS slot
FROM s
"""


@_query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizer_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_replay.encode_decode(docs, files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN, carry=["doc_id"])


def _dated_list(pages: DataFrame) -> DataFrame:
    """Dated lists over the hosts of the pages. The tables hold no list, so hashes of the patterns, which SQL
    can compute too, choose and date the entries: sites of three labels (those with a hyphen, and one in eight of the
    others), one whole host in six, one first path segment of a host in four, and the domains of two labels for ten
    days each. A pattern may be on several lists, and one in seven is removed at the time of its addition."""
    url = F.lower("url")
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    n = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    made = F.array(
        F.struct(F.lit("sites").alias("list"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")),
        F.struct(F.lit("hosts").alias("list"), host.alias("pattern")),
        F.struct(F.lit("domains").alias("list"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("pattern")),
        F.struct(F.lit("paths").alias("list"), F.regexp_extract(url, r"^[a-z]+://([^/?#]+/[^/?#]+)", 1).alias("pattern")),
    )
    every = pages.select(F.inline(made)).where("pattern != ''").distinct().withColumn("n", n)
    hyphen = F.col("pattern").like("%-%")
    named = F.when(F.col("list") == "sites", F.when(hyphen, F.lit("spam")).otherwise(F.lit("sampled"))).otherwise(F.col("list"))
    listed = every.where(
        (F.col("list") == "sites") & (hyphen | (F.col("n") % 8 == 0))
        | (F.col("list") == "hosts") & (F.col("n") % 6 == 0)
        | (F.col("list") == "domains")
        | (F.col("list") == "paths") & (F.col("n") % 4 == 0)
    ).withColumn("list", named)
    day, wide = F.col("n") % 300, F.col("list") == "domains"
    events = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.when(wide, F.lit("remove")).alias("action"), (day + 10).alias("day")),
        F.struct(F.when(F.col("n") % 3 == 0, F.lit("remove")).alias("action"), (day + 20).alias("day")),
        F.struct(F.when((F.col("n") % 5 == 0) & ~wide, F.lit("add")).alias("action"), (day + 45).alias("day")),
        F.struct(F.when(F.col("n") % 7 == 0, F.lit("remove")).alias("action"), day.alias("day")),
    )
    return listed.select("list", "pattern", F.inline(events)).select(
        "list", "pattern", "action", F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400).alias("at")
    )


@_query
def op7_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time; the page's number gives the hour of 2024 at which it counts as fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hour = F.pmod(F.col("page_id") * 37, F.lit(8760))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + hour * 3600))
    judged = url_lists.judge(captures, _dated_list(pages))
    return judged.select("page_id", "blocked", "n_lists", "lists", "matched", F.unix_timestamp("since").alias("since_s"))


ORACLE["op7_temporal_url_lists"] = r"""
WITH p AS (
  SELECT page_id, 1704067200 + (page_id * 37) % 8760 * 3600 AS at_s, regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1) AS host,
         regexp_extract(lower(url), '^[a-z]+://([^/?#]+/[^/?#]+)', 1) AS path
  FROM pages
), s AS (
  SELECT 'sites' AS kind, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS pattern FROM p UNION SELECT 'hosts', host FROM p
  UNION SELECT 'domains', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM p UNION SELECT 'paths', path FROM p
), n AS (SELECT kind, pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS n FROM s WHERE pattern <> ''),
listed AS (
  SELECT CASE WHEN kind = 'sites' THEN CASE WHEN pattern LIKE '%-%' THEN 'spam' ELSE 'sampled' END ELSE kind END AS list, pattern, n FROM n
  WHERE kind = 'domains' OR (kind = 'sites' AND (pattern LIKE '%-%' OR n % 8 = 0)) OR (kind = 'hosts' AND n % 6 = 0) OR (kind = 'paths' AND n % 4 = 0)
), ev AS (
  SELECT list, pattern, 'add' AS action, n % 300 AS day FROM listed
  UNION ALL SELECT list, pattern, 'remove', n % 300 + 10 FROM listed WHERE list = 'domains'
  UNION ALL SELECT list, pattern, 'remove', n % 300 + 20 FROM listed WHERE n % 3 = 0
  UNION ALL SELECT list, pattern, 'add', n % 300 + 45 FROM listed WHERE n % 5 = 0 AND list <> 'domains'
  UNION ALL SELECT list, pattern, 'remove', n % 300 FROM listed WHERE n % 7 = 0
), iv AS (
  SELECT list, pattern, action, 1704067200 + day * 86400 AS since_s,
         1704067200 + 86400 * lead(day) OVER (PARTITION BY list, pattern ORDER BY day, action) AS until_s
  FROM ev
), m AS (
  SELECT p.page_id, iv.list, iv.pattern, iv.since_s FROM p JOIN iv
  ON iv.action = 'add' AND iv.since_s <= p.at_s AND (iv.until_s IS NULL OR p.at_s < iv.until_s)
  AND (p.host = iv.pattern OR ends_with(p.host, '.' || iv.pattern) OR p.path = iv.pattern)
)
SELECT p.page_id, count(m.list) > 0 AS blocked, count(DISTINCT m.list) AS n_lists,
       coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists,
       max_by(m.pattern, (length(m.pattern), m.pattern)) AS matched, min(m.since_s)::BIGINT AS since_s
FROM p LEFT JOIN m ON m.page_id = p.page_id GROUP BY p.page_id
"""


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each repeated passage that is not the first of its kind."""
    found = cdc_dedup.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "start", "length", "n_words", F.col("first_id").alias("first_doc_id"), unsigned32(F.crc32(F.col("passage").cast("binary"))).alias("passage_crc32")
    )


@_query
def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bands = compression_bands.fit(docs, table(spark, sf_dir, "labels"))
    return compression_bands.quality_rules(docs, carry=["doc_id"], bands=bands, lang_col="lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_share"
    )


#: What a leaf of the manifest is made of.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the CRC of the id is even, the tampered text has lost its line ends; its leaf is folded with the siblings of the
    original. A null id is never tampered."""
    docs = table(spark, sf_dir, "documents")
    changed = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in LEAF]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), F.unhex(merkle.leaf_digest(*changed)))
    manifest = merkle.build(docs, LEAF, carry={"tampered": tampered})
    leaf, given = F.lower(F.hex("digest")), F.lower(F.hex(F.coalesce("tampered", "digest")))
    proved = merkle.prove(manifest).select(
        F.col("id").alias("doc_id"), leaf.alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), F.sha2(F.col("proof"), 256).alias("proof_sha256"),
        merkle.folded_root(manifest, given).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return made.codes.select("vec_id", "code", "error", "label_error", F.lit(made.sha256).alias("codebooks_sha256"))


#: Levels in SQL: above them is a single node in every table. CRC-32 of decimal ids, byte by byte.
_MERKLE_LEVELS = 16


def _levels_sql(name: str, leaves: str) -> str:
    """Nodes of all levels of ``leaves`` (tree, index, h), whose trees have ``size`` leaves each."""
    out = [f"{name}0 AS MATERIALIZED (SELECT tree, index, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(1, _MERKLE_LEVELS + 1):
        out.append(f"""{name}{k} AS MATERIALIZED (
  SELECT tree, index // 3 AS index, sha256(string_agg(h, '' ORDER BY index)) AS h, (any_value(n) + 2) // 3 AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, index // 3
)""")
    return ", ".join(out)


def _fold_sql(name: str, nodes: str, start: str) -> str:
    """From ``start`` (rid, tree, index, acc, proof) to the root of each row's tree, level by level."""
    out, last = [], start
    for k in range(_MERKLE_LEVELS):
        # the siblings of a run of three, to the left and to the right
        side = lambda at, op, k=k: f"(SELECT coalesce(string_agg(s.h, '' ORDER BY s.index), '') FROM {nodes}{k} s WHERE s.tree = f.tree AND s.index // 3 = f.index // 3 AND s.index {op} f.index)"
        out.append(f"""{name}s{k} AS (
  SELECT f.*, exists(SELECT 1 FROM {nodes}{k + 1} u WHERE u.tree = f.tree) AS more, {side(k, "<")} AS lo, {side(k, ">")} AS hi FROM {last} f
), {name}{k} AS MATERIALIZED (
  SELECT rid, tree, CASE WHEN more THEN index // 3 ELSE index END AS index, CASE WHEN more THEN sha256(lo || acc || hi) ELSE acc END AS acc,
         CASE WHEN more THEN proof || lo || hi ELSE proof END AS proof FROM {name}s{k}
)""")
        last = f"{name}{k}"
    return ", ".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE["op11_merkle_manifest"] = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS given
  FROM documents, crc
), sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
own AS MATERIALIZED (
  SELECT rid, doc_id, leaf AS h, given, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS index
  FROM d JOIN sources ON d.source IS NOT DISTINCT FROM sources.source
), {_levels_sql("lower", "own")},
roots AS MATERIALIZED ({" UNION ALL ".join(f"SELECT tree, h FROM lower{k} WHERE n = 1" for k in range(_MERKLE_LEVELS + 1))}),
tops AS (SELECT 0 AS tree, tree AS index, h FROM roots), {_levels_sql("upper", "tops")},
root AS MATERIALIZED ({" UNION ALL ".join(f"SELECT h AS root FROM upper{k} WHERE n = 1" for k in range(_MERKLE_LEVELS + 1))}),
a AS MATERIALIZED (SELECT rid, tree, index, given AS acc, '' AS proof FROM own), {_fold_sql("fold", "lower", "a")},
b AS MATERIALIZED (SELECT rid, 0 AS tree, tree AS index, acc, proof FROM fold{_MERKLE_LEVELS - 1}), {_fold_sql("over", "upper", "b")}
SELECT own.doc_id, own.h AS leaf, roots.h AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM own JOIN roots USING (tree) JOIN over{_MERKLE_LEVELS - 1} f USING (rid), root
"""


def _rounds_sql(rounds: int) -> str:
    """The codebooks of each round from those before, every part against every entry."""
    out = []
    for k in range(rounds):
        out.append(f"""near{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(e.entry, (p.cc - 2 * list_dot_product(p.c, e.c) + e.cc, e.entry)) AS entry FROM parts p JOIN book{k} e USING (part) GROUP BY rid, part
), mean{k} AS (
  SELECT part, entry, j, floor(sum(c[j]) / count(*)) AS x FROM near{k} JOIN parts USING (rid, part), w, range(1, w.w + 1) t(j) GROUP BY part, entry, j
), new{k} AS (SELECT part, entry, list(x ORDER BY j) AS c FROM mean{k} GROUP BY part, entry),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.c, b.c) AS c, list_dot_product(coalesce(n.c, b.c), coalesce(n.c, b.c)) AS cc FROM book{k} b LEFT JOIN new{k} n USING (part, entry)
)""")
    return ", ".join(out)


#: Exact in doubles for components like those of the tables; no two of their vectors differ in length.
ORACLE["op12_vector_codes"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT any_value(len(e)) // 4 AS w FROM v),
cut AS (SELECT rid, vec_id, part, list_slice(e, part * w + 1, (part + 1) * w) AS c FROM v, w, range(4) t(part)),
parts AS MATERIALIZED (SELECT *, list_dot_product(c, c) AS cc FROM cut),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id, e) - 1 AS entry FROM v QUALIFY entry < 256),
book0 AS MATERIALIZED (SELECT part, entry, c, cc FROM parts JOIN firsts USING (rid)),
{_rounds_sql(4)}, last AS MATERIALIZED (
  SELECT rid, part, arg_min(e.entry, (p.cc - 2 * list_dot_product(p.c, e.c) + e.cc, e.entry)) AS entry, min(p.cc - 2 * list_dot_product(p.c, e.c) + e.cc) AS d
  FROM parts p JOIN book4 e USING (part) GROUP BY rid, part
), coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY rid),
books AS (SELECT sha256(string_agg(c[j]::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM book4, w, range(1, w.w + 1) t(j))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (rid), books
"""


@_query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizer_files()
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.PATTERN)
