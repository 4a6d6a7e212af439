"""Queries over the given tables for the text operators, and the SQL that checks them.

The contract columns are derived here; the operators keep their own outputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm import simhash
from hydrospark.llm.chat_format import answered_pairs, spans_text
from hydrospark.llm.common import held_out, shuffle_parts, table
from hydrospark.llm.decontaminate import leaked_regions
from hydrospark.llm.ngram_join import ngram_jaccard_components
from hydrospark.llm.orchard_clustering import cluster_vectors, with_inertia
from hydrospark.llm.pieces import encode_pieces, read_pieces, zipf_scores
from hydrospark.llm.pitman_yor import score_texts
from hydrospark.llm.quality_rules import RULES, SHOWN_STOP_WORDS, judge_quality
from hydrospark.llm.sharding import extendible_shards
from hydrospark.llm.substring_dedup import remove_repeats
from hydrospark.llm.target_resampling import importance_resample
from hydrospark.llm.token_counts import read_ranks, section_token_counts
from hydrospark.llm.toxicity import fit_toxicity, score_toxicity
from hydrospark.scratch import cut

#: Folder of the public vocabulary files; they are read where they are, on the driver.
TOKENIZERS = "/opt/tokenizers"
TOXIC_FROM = 0.3
SHARD_BYTES = 1 << 20
#: Bits of 128 within which texts count as near copies; the README has the recall.
RADIUS = 14


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), shingle=4, threshold=85, count_links=True)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, *toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return extendible_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES).withColumnRenamed("key", "doc_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = answered_pairs(turns)
    return made.withColumns({c: spans_text(c) for c in ("chosen_mask", "rejected_mask")})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For ids divisible by 50: ``n_near``, how many documents lie within the radius (itself included), and
    ``near_fingerprints``, the distinct fingerprints found; ``fingerprint`` tells which documents have them."""
    docs = table(spark, sf_dir, "documents")
    marked = cut(simhash.edited_fingerprints(docs))
    found = simhash.with_likeness(marked)
    prints = marked.groupBy("fp1", "fp2").agg(F.count("*").alias("documents"))
    asked = marked.where("doc_id % 50 = 0").select("fp1", "fp2").distinct()
    near = simhash.within_radius(asked, prints, RADIUS)
    near = near.join(prints.withColumnsRenamed({"fp1": "g1", "fp2": "g2"}), ["g1", "g2"]).groupBy("fp1", "fp2").agg(
        F.sum("documents").alias("n_near"), F.array_sort(F.collect_list(simhash.as_hex("g1", "g2"))).alias("near_fingerprints"))
    found = found.join(near, ["fp1", "fp2"], "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_hex("fp1", "fp2").alias("fingerprint"),
        simhash.as_hex("e1", "e2").alias("edited_fingerprint"), "near_edited", "near_next",
        *[F.when(F.col("doc_id") % 50 == 0, F.col(c)).alias(c) for c in ("n_near", "near_fingerprints")])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), 7, 2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))
    return section_token_counts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.size("regions").alias("n_regions"), (F.size("regions") > 0).alias("leaked"),
        F.array_sort(F.array_distinct("regions.item_id")).alias("item_ids"), "regions")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=13, with_text=False).drop("th")


def vocabulary():
    return zipf_scores(read_pieces(os.path.join(TOKENIZERS, "piece_bpe_32k.model")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary(), with_pieces=False).drop("pieces")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col(f"counts.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1, longest=1, buckets=10_000,
        percent=10, least_words=20, seed=2024)
    return drawn.drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_toxicity, op3_sharding, op4_chat_format, op5_simhash, op6_lm_scoring, op7_token_counts,
    op8_decontamination, op9_substring_dedup, op10_sentencepiece, op11_centroid_clustering, op12_quality_rules,
    op13_importance_resampling)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Plain Lloyd rounds over every pair of vector and centroid."""
    parts = [f"""
kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, vec_id, unnest(range({dims})) AS d, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, d, x AS y FROM first JOIN v USING (r))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, (arg_min(c, dist * {k} + c))::INT AS c, min(dist) AS dist FROM
  (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS dist FROM v JOIN c{i} USING (d) GROUP BY 1, 2) GROUP BY 1)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    return f"""WITH {",".join(parts)},
per AS (SELECT c, sum(dist)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1),
named AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, c AS "cluster", dist AS distance, cluster_inertia, (SELECT sum(dist)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN per USING (c) JOIN named USING (c)"""


def _quality_sql() -> str:
    bounds = {rule.name: rule for rule in RULES}
    tests = []
    for rule in bounds.values():
        whole = "1" if rule.whole == "one" else rule.whole
        tests += [f"100 * {rule.part} {sign} {bound} * {whole}" for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None]
    stops = ", ".join(f"'{w}'" for w in SHOWN_STOP_WORDS)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY 1),
n AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x21-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letterless,
  len(list_filter(ws, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_capital,
  len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop,
  len(list_filter(ls, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS n_bullet,
  len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis
  FROM w LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


#: CRC-32 of a text's bytes, by the reflected polynomial bit by bit.
CRC = """
bits AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT FOR k IN range(8)]),
  lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
crc AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT,
  list_transform(range(octet_length(encode(word))), lambda j: ('0x' || hex(encode(word))[2 * j + 1:2 * j + 2])::UBIGINT)),
  lambda a, z: xor(a >> 8, tab[((xor(a, z) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket FROM (SELECT DISTINCT word FROM words) w, bits)"""
HASHED_WORD = r"regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_quality_rules": _quality_sql(),
    "op13_importance_resampling": rf"""
WITH d AS (SELECT doc_id, {HASHED_WORD} AS ws FROM (SELECT doc_id, {LOWERED} AS t FROM documents)),
b AS (SELECT {HASHED_WORD} AS ws FROM (SELECT {LOWERED} AS t FROM benchmark)),
dw AS (SELECT doc_id, unnest(ws) AS word FROM d), bw AS (SELECT unnest(ws) AS word FROM b),
words AS (SELECT word FROM dw UNION ALL SELECT word FROM bw),{CRC},
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
   / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
   FROM (SELECT DISTINCT bucket FROM crc) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
mean AS (SELECT doc_id, sum(gain)::BIGINT AS total, count(*) AS n FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY 1),
w AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
   ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN mean USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank
FROM x LEFT JOIN r USING (doc_id)""",
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWERED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
degree AS (SELECT x AS doc_id, count(*) AS links FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id, coalesce(links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN degree USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY 1, 2, links""",
    "op3_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
           ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS h FROM documents),
levels AS (SELECT doc_id, bytes, depth::INT AS depth, h >> (60 - depth) AS shard FROM d, range(0, 61) t(depth)),
fits AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes FROM levels GROUP BY 1, 2 HAVING sum(bytes) <= {SHARD_BYTES}),
best AS (SELECT doc_id, bytes, min(depth) AS depth FROM levels JOIN fits USING (depth, shard) GROUP BY 1, 2)
SELECT best.doc_id, best.bytes, best.depth, fits.shard_bytes, 0::BIGINT AS page,
       CASE WHEN best.depth = 0 THEN '' ELSE lpad(to_binary(fits.shard), best.depth, '0') END AS shard
FROM best JOIN d USING (doc_id) JOIN fits ON fits.depth = best.depth AND fits.shard = d.h >> (60 - best.depth)""",
    "op4_chat_format": """
WITH said AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last_ AS (SELECT conv_id, max(turn) AS last FROM said WHERE role = 'assistant' GROUP BY 1),
answer AS (SELECT xor(conv_id, 1) AS conv_id, max(text) AS text FROM said JOIN last_ USING (conv_id) WHERE role = 'assistant' AND turn = last GROUP BY 1),
sides AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM said
  UNION ALL SELECT conv_id, 1, turn, role, text FROM said LEFT JOIN last_ USING (conv_id) WHERE last IS NULL OR turn < last
  UNION ALL SELECT conv_id, 1, 2147483647, 'assistant', text FROM answer WHERE conv_id IN (SELECT conv_id FROM said)),
t AS (SELECT pair_id, side, role, text, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS pos FROM sides),
both_ AS (SELECT pair_id, pos, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b,
          count(DISTINCT role || chr(0) || text) AS kinds FROM t GROUP BY 1, 2),
cut_ AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT (a = 1 AND b = 1 AND kinds = 1)) - 1, max(pos))::INT AS n FROM both_ GROUP BY 1),
r AS (SELECT t.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN cut_ USING (pair_id)),
placed AS (SELECT *, (sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY pos) - length(shown))::BIGINT AS place FROM r WHERE pos > n),
spans AS (SELECT pair_id, side, string_agg((place + length(role) + 5) || '-' || (place + length(shown)), ',' ORDER BY pos) AS mask
          FROM placed WHERE role = 'assistant' GROUP BY 1, 2),
text_ AS (SELECT pair_id, string_agg(shown, '' ORDER BY pos) FILTER (pos <= n AND (side = 0)) AS prompt,
          string_agg(shown, '' ORDER BY pos) FILTER (pos > n AND side = 0) AS chosen,
          string_agg(shown, '' ORDER BY pos) FILTER (pos > n AND side = 1) AS rejected FROM r GROUP BY 1)
SELECT pair_id::BIGINT AS pair_id, n AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
       coalesce(c.mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(j.mask, '') AS rejected_mask
FROM text_ JOIN cut_ USING (pair_id) LEFT JOIN (SELECT pair_id, mask FROM spans WHERE side = 0) c USING (pair_id)
LEFT JOIN (SELECT pair_id, mask FROM spans WHERE side = 1) j USING (pair_id)""",
    "op9_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT g, min(doc_id) AS least FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id) LEFT JOIN lost USING (doc_id)""",
}
