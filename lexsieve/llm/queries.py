"""Each operator over its whole table: name -> (spark, folder) -> DataFrame, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm import (
    bpe, centroids, chat, divergence, embeddings, fingerprints, jaccard, mixing, passages, quality, secrets,
    sharding, toxicity,
)
from lexsieve.llm.common import code_points, table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shuffle_shards(table(spark, folder, "documents"), SHARDS)
    return sharded.select(
        "doc_id", "size", F.crc32(code_points(F.col("text"))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return quality.classify(documents).select("doc_id", "quality", "keep")


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = embeddings.audited_vectors(table(spark, folder, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    found = F.col("secrets")

    def count(order: int):
        return F.size(F.filter(found, lambda s: s["order"] == order)).cast("long")

    base = F.filter(found, lambda s: s["order"] < 3)
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(found).alias("spans"), count(3).alias("n_entropy"),
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    placed = fingerprints.with_next(documents)
    text = code_points(F.col("text"))
    made = placed.select(
        "doc_id", F.length(text).cast("long").alias("n_chars"),
        fingerprints.edited(text, F.col("next_text")).alias("edited"),
        fingerprints.anchors(text).alias("own"),
        fingerprints.anchors(F.col("next_text")).alias("next"),
    ).withColumn("changed", fingerprints.anchors(F.col("edited")))
    own, changed = F.col("own"), F.col("changed")
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(own).alias("fingerprint"),
        fingerprints.fingerprint(changed).alias("edited_fingerprint"),
        fingerprints.likeness(own, changed).alias("near_edited"),
        fingerprints.likeness(own, F.col("next")).alias("near_next"),
        fingerprints.in_place(own, changed).alias("edited_in_place"),
    )


PROBE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    talks = table(spark, folder, "conversations").select(*columns).unionByName(probe)
    read = chat.read_back(talks, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"),
        F.length("losses").cast("long").alias("loss_chars"), F.sha2("losses", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(documents).select("doc_id", "class_id", "n_links", "kept")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(documents, TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"), least_docs=30, top=50)


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"), clusters=8, rounds=10)
    return found.select("vec_id", *centroids.OUTPUTS)


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = passages.contamination(documents, table(spark, folder, "benchmark"), length=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_fingerprints": op6_fingerprints,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_chat": op8_chat,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_centroids": op12_centroids,
    "op13_decontamination": op13_decontamination,
}

ORACLE: dict[str, str] = {
    "op4_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')), source ORDER BY source) - 1 AS nth,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source
), levels(step, level) AS (
  SELECT 0, 0::DOUBLE
  UNION ALL
  SELECT step + 1,
    ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
       - sum(CASE WHEN weight * level > source_size * 2 THEN source_size * 2 ELSE 0 END)::BIGINT)
    / nullif(sum(CASE WHEN weight * level > source_size * 2 THEN 0 ELSE weight END)::BIGINT, 0)
  FROM levels, s WHERE step < 60 GROUP BY step, level
), final AS (SELECT max(level) AS level FROM levels),
t AS (
  SELECT source, source_size, least((source_size * 2)::DOUBLE, weight * level) AS target
  FROM s, final
), r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest || ':' || nth), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r""",
    "op8_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM range(2) AS r(n)
), w AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(16 + length(role) + length(text)
        + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) OVER o AS so_far
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                      ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), ''))
         AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN so_far ELSE 0 END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id""",
    "op11_divergence": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT r, lang, source, unnest(w) AS term FROM t),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM t)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)
), c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) WHERE part = 'pair' OR rank <= 50""",
    "op12_centroids": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), first AS (
  SELECT e, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8
), rounds(step, c) AS (
  SELECT 0, (SELECT list(e ORDER BY h) FROM first)
  UNION ALL
  SELECT step + 1, list(centre ORDER BY k) FROM (
    SELECT o.step, o.k, CASE WHEN any_value(s.total) IS NULL THEN any_value(o.centre)
                             ELSE list(s.total // s.n - (s.total % s.n < 0)::INT ORDER BY s.d) END AS centre
    FROM (SELECT step, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS centre FROM rounds WHERE step < 10) o
    LEFT JOIN (
      SELECT k, d, sum(x)::BIGINT AS total, count(*) AS n FROM (
        SELECT list_position(far, list_min(far)) AS k, unnest(range(1, 65)) AS d, unnest(e) AS x FROM (
          SELECT e, list_transform(c, lambda m: list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT) AS far
          FROM v, (SELECT c FROM rounds WHERE step < 10)
        )
      ) GROUP BY k, d
    ) s ON s.k = o.k
    GROUP BY o.step, o.k
  ) GROUP BY step
), final AS (SELECT c FROM rounds WHERE step = 10),
told AS (
  SELECT vec_id, c, list_transform(c, lambda m: list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT) AS far
  FROM v, final
), near AS (
  SELECT vec_id, (list_position(far, list_min(far)) - 1)::INT AS cluster, list_min(far) AS distance, c FROM told
)
SELECT vec_id, cluster, distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c[cluster + 1], ',')) AS centroid_sha256
FROM near""",
    "op13_decontamination": r"""
WITH t AS (
  SELECT 1 AS whole, row_number() OVER () AS r, doc_id AS id, NULL AS item, text FROM documents
  UNION ALL
  SELECT 0, row_number() OVER (), NULL, item_id::VARCHAR, text FROM benchmark
), s AS (
  SELECT whole, r, id, item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), windows AS (
  SELECT DISTINCT item, words, len(words) AS n FROM (
    SELECT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS words
    FROM s WHERE whole = 0 AND len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, n, start, w[start:start + n - 1] AS words FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS start FROM s, lengths WHERE whole = 1 AND len(w) >= n)
), hits AS (SELECT DISTINCT r, start, runs.n, item FROM runs JOIN windows USING (words)),
covered AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(start, start + n)) AS place FROM hits) GROUP BY r
), listed AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r
)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM s LEFT JOIN covered USING (r) LEFT JOIN listed USING (r) WHERE whole = 1""",
}
