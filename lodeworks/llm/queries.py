"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontamination, lines, mixing, packing, prefix_trie, quality, rules, secrets, sharding, simhash, suffixes, whitening
from .common import read
from .hash_sql import xxh64


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(read(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), headed AS (
  SELECT c.conv_id, perspective, turn, role, coalesce(text, '') AS body,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
      WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user:' || coalesce(role, 'unknown') || '|>' || chr(10) END AS head
  FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, head || body || chr(10) AS segment, length(head) + length(body) + 1 AS n_chars,
    row_number() OVER w - 1 AS position,
    sum(length(head) + length(body) + 1) OVER (w ROWS UNBOUNDED PRECEDING) - length(head) - length(body) - 1 AS start
  FROM headed
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(body))
)
SELECT conv_id, perspective, turn, CAST(position AS BIGINT) AS position, role, segment, CAST(start AS BIGINT) AS start,
  CAST(n_chars AS BIGINT) AS n_chars,
  CAST(CASE WHEN role = perspective THEN start + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = perspective THEN start + n_chars END AS BIGINT) AS mask_end
FROM placed
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_frequent_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), threshold=10)
    return found.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.mix(docs, mixing.label_weights(labels)).drop("key")


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, avg(CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 0) AS size,
    -ln((('0x' || substr(md5('23:' || coalesce(doc_id::VARCHAR, 'none:' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52))
      / coalesce(w, 1) AS key
  FROM documents LEFT JOIN w USING (doc_id)
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY place) - cap)) / sum(weight) OVER (ORDER BY place DESC) AS level FROM o
), t AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, place) FROM l WHERE level * weight < cap), cap)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t
), p AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, source, epochs::INT AS epochs,
  (size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


OP12_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), v AS (
  SELECT conv_id, turn, md5(coalesce(length(role), 0) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, octet_length(encode(coalesce(text, ''))) AS b
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(s ORDER BY turn NULLS FIRST, base64(unhex(s))) AS s, list(b ORDER BY turn NULLS FIRST, base64(unhex(s))) AS b FROM v GROUP BY conv_id
), h AS (
  SELECT conv_id, s, b, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 9 AS h
  FROM c, tab
), r AS (
  SELECT h.conv_id, list_concat(coalesce(o.s[:h.h], []), h.s[h.h + 1:]) AS s, list_concat(coalesce(o.b[:h.h], []), h.b[h.h + 1:]) AS b
  FROM h LEFT JOIN c o ON o.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, s[:d] AS node, d, len(s) AS n, coalesce(b[d], 0) AS bytes FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)
), nodes AS (
  SELECT node, d, min(conv_id) AS id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS sha
  FROM m GROUP BY node, d
), kids AS (
  SELECT node[:-2] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), up AS (
  SELECT node[:a] AS node, count(*) FILTER (k.n IS NULL) AS leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT node, n_convs, bytes, unnest(range(d + 1)) AS a FROM nodes) x LEFT JOIN kids k USING (node) GROUP BY 1
)
SELECT n.id AS conv_id, n.d::BIGINT AS depth, p.id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, n.sha AS ends_sha256
FROM nodes n LEFT JOIN kids k USING (node) JOIN up u USING (node) LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[:-2]
"""


OP7_SQL = """
WITH line AS (
  SELECT doc_id, unnest(part) AS line, generate_subscripts(part, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY doc_id
"""


#: CRC-32 from its polynomial: a table of 256 remainders, then one step a byte.
OP1_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT doc_id, source, length(x) // 2 + 1 AS size, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM d, tab
), r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('17:' || doc_id)) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS total
  FROM (SELECT *, coalesce('s' || source, 'n') AS stratum FROM b)
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * total), stratum, rank) - 1 AS at_, count(*) OVER () AS n FROM r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(at_ * 16 // n AS INT) AS shard,
  CAST(at_ - ((at_ * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p
"""

OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), f AS (
  SELECT s, min(doc_id) AS first_id FROM w GROUP BY s
), r AS (
  SELECT w.doc_id, i, i > lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) + 50 AS apart FROM w JOIN f USING (s) WHERE first_id < w.doc_id
), g AS (
  SELECT doc_id, i, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run
), gaps AS (
  SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
  sha256(unhex(coalesce(string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(x, 2 * coalesce(max(z), 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gaps USING (doc_id) GROUP BY d.doc_id, n, x
"""


#: All of op8's columns but the learned verdict, which SQL cannot learn: tests hold the query against it.
OP8_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), r AS (
  SELECT doc_id, count(DISTINCT at_) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_ FROM g WHERE times > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""

#: Fingerprints from XXH64 written out, links by all pairs of different fingerprints, components by closure.
OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda y: y <> '') AS ws FROM d
), shingles AS (
  SELECT doc_id, sh, count(*) AS n_times FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
  ) GROUP BY ALL
), {xxh64("shingles", "sh", seed=42)}, bits AS (
  SELECT doc_id, b, 2 * sum(n_times * (h >> b & 1)) > sum(n_times) AS one
  FROM (SELECT doc_id, n_times, h, unnest(range(64))::UBIGINT AS b FROM shingles JOIN hashed USING (sh)) GROUP BY ALL
), prints AS (
  SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT doc_id, bit_or(1::UBIGINT << b) FILTER (one) AS fp FROM bits GROUP BY doc_id) USING (doc_id)
), f AS (
  SELECT DISTINCT fp FROM prints
), e AS (
  SELECT p.fp AS a, q.fp AS b FROM f p JOIN f q ON p.fp <> q.fp AND bit_count(xor(p.fp, q.fp)) <= 3
), reached AS (
  SELECT fp, fp AS other FROM f UNION SELECT r.fp, e.b FROM reached r JOIN e ON e.a = r.other
), named AS (
  SELECT r.fp, min(p.doc_id) AS component_id FROM reached r JOIN prints p ON p.fp = r.other GROUP BY r.fp
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scans": op2_secret_scans,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op4_simhash_near_dedup": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op12_conversation_prefix_trie": OP12_SQL,
    "op13_source_mixing": OP13_SQL,
}
