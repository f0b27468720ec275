"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import (op1_embedding_dedup, op2_hash_tree_shards, op3_minhash_dedup, op4_quality_rules, op5_toxicity,
                            op6_quality_lm, op7_reply_trees, op8_language_id, op9_source_mix, op10_bpe_automaton,
                            op11_line_dedup, op12_merkle_manifest, op13_prefix_trie)
from tablescope.llm.common import load

TOKENIZER = "byte_bpe_50k.json"


def op1(spark: SparkSession, d: str) -> DataFrame:
    return op1_embedding_dedup.near_vectors(load(spark, d, "embeddings")).drop("n_copies")


def op2(spark: SparkSession, d: str) -> DataFrame:
    return op2_hash_tree_shards.shard_documents(load(spark, d, "documents"))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return op3_minhash_dedup.near_documents(load(spark, d, "documents"))


def op4(spark: SparkSession, d: str) -> DataFrame:
    return op4_quality_rules.judge(load(spark, d, "documents"), load(spark, d, "labels"))


def op5(spark: SparkSession, d: str) -> DataFrame:
    return op5_toxicity.score(load(spark, d, "documents"), load(spark, d, "labels"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    return op6_quality_lm.judge(load(spark, d, "documents"), load(spark, d, "labels"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts look like control strings."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return op7_reply_trees.format_conversations(rows.unionByName(own))


def op8(spark: SparkSession, d: str) -> DataFrame:
    return op8_language_id.identify(load(spark, d, "documents"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    return op9_source_mix.mix_digest(load(spark, d, "documents"))


def op10(spark: SparkSession, d: str) -> DataFrame:
    return op10_bpe_automaton.encode_digest(load(spark, d, "documents"), public_tokenizers.path(TOKENIZER))


def op11(spark: SparkSession, d: str) -> DataFrame:
    return op11_line_dedup.line_digest(load(spark, d, "documents"))


def op12(spark: SparkSession, d: str) -> DataFrame:
    return op12_merkle_manifest.manifest_digest(load(spark, d, "documents"))


def op13(spark: SparkSession, d: str) -> DataFrame:
    return op13_prefix_trie.trie(load(spark, d, "conversations"))


QUERIES = {
    "op1_embedding_dedup": op1,
    "op2_hash_tree_shards": op2,
    "op3_minhash_dedup": op3,
    "op4_quality_rules": op4,
    "op5_toxicity": op5,
    "op6_quality_lm": op6,
    "op7_reply_trees": op7,
    "op8_language_id": op8,
    "op9_source_mix": op9,
    "op10_bpe_automaton": op10,
    "op11_line_dedup": op11,
    "op12_merkle_manifest": op12,
    "op13_prefix_trie": op13,
}

_COMPONENTS = """
reach(node, seen) AS (
  SELECT id, id FROM nodes
  UNION SELECT r.node, CASE WHEN l.a = r.seen THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON r.seen = l.a OR r.seen = l.b),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

#: crc32 of a number's decimal text, bit by bit.
_CRC = """xor(list_reduce(flatten(list_transform(string_split({}::VARCHAR, ''), lambda d: list_transform(range(0, 8), lambda b: (ord(d) >> b) & 1))),
    lambda a, bit: xor(a >> 1, (xor(a, bit) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"""

#: crc32 of a text's UTF-8 bytes, bit by bit.
_CRC_BYTES = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode({})), '..'),
    lambda d: list_transform(range(0, 8), lambda b: (('0x' || d)::BIGINT >> b) & 1)))),
    lambda a, bit: xor(a >> 1, (xor(a, bit) & 1) * 3988292384)), 4294967295)"""

_DRAW = "-ln((('0x' || substr(md5(key || '/' || {}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {}"

_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))

SQL = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q
  ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.98),
{_COMPONENTS},
n AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT e.vec_id, coalesce(n.k, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id LEFT JOIN n ON n.id = e.vec_id""",
    "op2_hash_tree_shards": f"""
WITH leaves AS (SELECT i::INTEGER AS shard, 'r' || (i // 8) AS region, 'k' || (i // 4) AS rack, 1::DOUBLE AS weight, unnest([false, true]) AS more FROM range(0, 16) t(i)
  UNION ALL VALUES (16, 'r+16', 'k+16', 1, true)),
keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, chr(0) || 'null') AS key FROM documents),
a AS (SELECT key, more, region FROM keys, (SELECT more, region, sum(weight) AS w FROM leaves GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY key, more ORDER BY {_DRAW.format("'region:' || region", "w")}, region) = 1),
b AS (SELECT key, more, region, rack FROM a JOIN (SELECT more, region, rack, sum(weight) AS w FROM leaves GROUP BY ALL) USING (more, region)
  QUALIFY row_number() OVER (PARTITION BY key, more ORDER BY {_DRAW.format("'rack:' || region || ':' || rack", "w")}, rack) = 1),
c AS (SELECT key, more, shard FROM b JOIN leaves USING (more, region, rack)
  QUALIFY row_number() OVER (PARTITION BY key, more ORDER BY {_DRAW.format("'shard:' || region || '/' || rack || ':' || shard", "weight")}, shard::VARCHAR) = 1),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS key, coalesce(strlen(text), 0) + 1 AS size, CASE WHEN text IS NOT NULL THEN {_CRC_BYTES.format("text")} END AS text_crc32 FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, c.shard,
  row_number() OVER (PARTITION BY c.shard ORDER BY {_CRC.format("concat_ws('/', doc_id, size, text_crc32)")} % 1024, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot,
  g.shard AS grown_shard
FROM d JOIN c ON c.key = d.key AND NOT c.more JOIN c g ON g.key = d.key AND g.more""",
    "op3_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
nodes AS (SELECT doc_id AS id FROM documents),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS k
  FROM g p JOIN g q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL) WHERE 100 * k >= 75 * (n + m - k)),
{_COMPONENTS}
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN comp c ON c.node = s.doc_id""",
    "op7_reply_trees": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(\||/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS written FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(written) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id <> c.last, false) AS lost FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE f AS (SELECT doc_id, source, {_LEAF} AS head, text,
    CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(found) || ':' || found, '-')) AS found_leaf FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM d),
t(source, k, pos, h, n) AS (
  SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM l
  UNION ALL SELECT source, k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, k, pos // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, k AS height FROM t WHERE n = 1),
u(k, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM s
  UNION ALL SELECT k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY k, pos // 3, n),
a AS (SELECT *, (pos // pow(3, k)::BIGINT) AS own FROM (SELECT source, pos, unnest(range(0, height)) AS k FROM (SELECT l.source, l.pos, s.height FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source))),
steps AS (SELECT a.source, a.pos, a.k, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < a.own) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > a.own) AS r
  FROM a JOIN t ON t.source IS NOT DISTINCT FROM a.source AND t.k = a.k AND t.pos // 3 = a.own // 3 GROUP BY ALL),
b AS (SELECT *, (pos // pow(3, k)::BIGINT) AS own FROM (SELECT source, pos, unnest(range(0, (SELECT max(k) FROM u))) AS k FROM s)),
more AS (SELECT b.source, b.k, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < b.own) AS l, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > b.own) AS r
  FROM b JOIN u ON u.k = b.k AND u.pos // 3 = b.own // 3 GROUP BY ALL),
every AS (SELECT source, pos, k, coalesce(l, '') AS l, coalesce(r, '') AS r FROM steps
  UNION ALL SELECT x.source, x.pos, s.height + m.k, coalesce(m.l, ''), coalesce(m.r, '') FROM l x JOIN s ON s.source IS NOT DISTINCT FROM x.source JOIN more m ON m.source IS NOT DISTINCT FROM x.source),
path AS (SELECT l.source, l.pos, l.doc_id, l.leaf, l.found_leaf, coalesce(list({{'l': e.l, 'r': e.r}} ORDER BY e.k) FILTER (e.k IS NOT NULL), []) AS p
  FROM l LEFT JOIN every e ON e.source IS NOT DISTINCT FROM l.source AND e.pos = l.pos GROUP BY ALL),
fold(source, pos, k, h) AS (
  SELECT source, pos, 0, found_leaf FROM path
  UNION ALL SELECT f.source, f.pos, f.k + 1, sha256(p.p[f.k + 1].l || f.h || p.p[f.k + 1].r)
  FROM fold f JOIN path p ON p.source IS NOT DISTINCT FROM f.source AND p.pos = f.pos WHERE f.k < len(p.p)),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(array_to_string(list_transform(p.p, lambda x: x.l || x.r), '')) AS proof_sha256,
  f.h AS folded_root, f.h = root.root AS verified
FROM path p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN fold f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos AND f.k = len(p.p), root""",
    "op13_prefix_trie": f"""
WITH r AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS at,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {_CRC.format("c")} % 6 AS h FROM (SELECT DISTINCT c FROM r)),
x AS (SELECT h.c, 0 AS own, r.at, r.role, r.text FROM h JOIN r ON r.c = h.c - h.c % 100 AND r.at < h.h
  UNION ALL SELECT h.c, 1, r.at, r.role, r.text FROM h JOIN r ON r.c = h.c AND r.at >= h.h),
built AS (SELECT h.c, coalesce(list({{'role': x.role, 'text': x.text}} ORDER BY x.own, x.at) FILTER (x.c IS NOT NULL), []) AS t FROM h LEFT JOIN x ON x.c = h.c GROUP BY h.c),
m AS (SELECT t[:d] AS p, d, c, len(t) = d AS ends FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
sub AS (SELECT p[:e] AS p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT node.p, kids.n IS NULL AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * length(node.p[d].text) ELSE 0 END AS saved, unnest(range(0, d + 1)) AS e
        FROM node LEFT JOIN kids ON kids.p = node.p) GROUP BY ALL)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, sub.n_leaves, sub.saved_tokens, node.ends_sha256
FROM node JOIN sub ON sub.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node up ON node.d > 0 AND up.p = node.p[:node.d - 1]""",
}
