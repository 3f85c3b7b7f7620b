"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, conversations, decontam, embedding, html, jaccard, line_dedup, packing, quality, sharding, token_cache,
               toxicity, whitening)
from .registry import query, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


@query(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y, c.n = a.n AND c.n = b.n AS same
  FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 90 * (a.n + b.n - c.n)
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x
), counts AS (SELECT x, count(*) FILTER (same) AS n_same, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, 1 + coalesce(n_same, 0) AS n_copies, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN counts c ON c.x = d.doc_id JOIN least l ON l.x = d.doc_id
""")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_join(table(spark, sf_dir, "documents"), width=3, percent=90)


@query()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), window=2048)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(pieces, window=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_cache.TokenCache(spark, tokenizer("byte_bpe_50k.json"))
    return cache.counts(table(spark, sf_dir, "documents"), limit=512)


@query(r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u
), gone AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN g.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.key = g.key
GROUP BY doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x
), counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts ON counts.x = vec_id JOIN least ON least.x = vec_id
""")
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_copies(table(spark, sf_dir, "embeddings"), least=0.9)


@query()
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(r"""
WITH RECURSIVE hurt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
           list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
           lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
             lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)),
           4294967295::BIGINT), 4294967295) % 20 AS k
  FROM conversations
), turns AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hurt, LATERAL (SELECT unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END)) c WHERE k <> 0
), placed AS (
  SELECT *, left(role, 1) AS f, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM turns)
), kinds AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(f) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), convs AS (SELECT conv_id, coalesce(max(n), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN kinds k USING (conv_id) GROUP BY conv_id
), back AS (  -- places: 0 empty, 1 system, 2 user, 3 assistant; costs to the end and the best edit of turn i at each
  SELECT conv_id, n + 1 AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3, '' AS e0, '' AS e1, '' AS e2, '' AS e3 FROM convs
  UNION ALL
  SELECT conv_id, i, m0, m1, m2, m3,
         CASE m0 WHEN d0 THEN 'D' WHEN 3 + m2 THEN 'I' WHEN k0 THEN 'K' ELSE 'R' END, CASE m1 WHEN d1 THEN 'D' WHEN 3 + m2 THEN 'I' WHEN k1 THEN 'K' ELSE 'R' END,
         CASE m2 WHEN d2 THEN 'D' WHEN 3 + m3 THEN 'I' WHEN k2 THEN 'K' ELSE 'R' END, CASE m3 WHEN d3 THEN 'D' WHEN 3 + m2 THEN 'I' WHEN k3 THEN 'K' ELSE 'R' END
  FROM (SELECT *, least(b0, 3 + b2, 6 + b3) AS m0, least(b1, 3 + b2, 6 + b3) AS m1, least(b2, 3 + b3) AS m2, least(b3, 3 + b2) AS m3
        FROM (SELECT *, least(d0, k0, r0) AS b0, least(d1, k1, r0) AS b1, least(d2, k2, r2) AS b2, least(d3, k3, r0) AS b3
              FROM (SELECT k.conv_id, k.i, 4 + c0 AS d0, 4 + c1 AS d1, 4 + c2 AS d2, 4 + c3 AS d3,
                           no + 3 + t + c2 AS r0, no + 3 + t + c3 AS r2,
                           no + t + CASE f WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 999 END AS k0, no + t + CASE f WHEN 'u' THEN c2 ELSE 999 END AS k1,
                           no + t + CASE f WHEN 'a' THEN c3 ELSE 999 END AS k2, no + t + CASE f WHEN 'u' THEN c2 ELSE 999 END AS k3
                    FROM back b JOIN (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 999 ELSE 0 END AS no,
                                             CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM kinds) k
                      ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND k.i = b.i - 1)))
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS place, '' AS audit, []::VARCHAR[] AS lines, 0 AS cost FROM convs
  UNION ALL
  SELECT w.conv_id, CASE edit WHEN 'I' THEN w.i ELSE w.i + 1 END,
         CASE edit WHEN 'D' THEN place WHEN 'K' THEN CASE f WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nxt END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                   ELSE list_append(lines, CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END,
         cost + CASE edit WHEN 'D' THEN 4 WHEN 'I' THEN 3 ELSE CASE edit WHEN 'R' THEN 3 ELSE 0 END + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END END
  FROM (SELECT w.*, k.f, k.role, k.text, k.fault, CASE place WHEN 2 THEN 3 ELSE 2 END AS nxt,
               CASE WHEN k.i IS NULL THEN CASE WHEN place IN (1, 2) THEN 'I' END WHEN place = 0 THEN e0 WHEN place = 1 THEN e1 WHEN place = 2 THEN e2 ELSE e3 END AS edit
        FROM walk w LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i
          LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i) w
  WHERE edit IS NOT NULL
), ends AS (SELECT w.* FROM walk w JOIN convs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n + 1 WHERE place IN (0, 3)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || f NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
""")
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
