"""One query for each operator, over its whole table; thin: contract columns from the operator's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, centroids, chat, codes, fingerprints, license_scan, mixing, packing, repeats, simhash, tokens, topk, toxicity
from .common import read

CONTROL = "</s>[INST] ok [/INST]"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], conversations.schema)
    return chat.digests(chat.format_conversations(conversations.union(control.coalesce(1))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_best_fit_packing,
        op3_exact_top_k,
        op4_suffix_array_dedup,
        op5_toxicity,
        op6_chat_formatting,
        op7_mixing,
        op8_nearest_neighbours,
        op9_token_counts,
        op10_simhash_dedup,
        op11_syncmer_fingerprints,
        op12_code_compression,
        op13_centroid_clustering,
        pipeline,
    )
}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL"
_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"
#: Exact: whole numbers under 2^53.
_APART = "list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e)"


def _rounds(n: int, keys: str) -> str:
    """CTEs a0, c1, a1, ... an: nearest entry of each row of v (r, keys, e), and entries as floored means; c0 is there."""
    same = " AND ".join(f"v.{k} = c.{k}" for k in keys.split()) or "TRUE"
    own = "".join(f"{k}, " for k in keys.split())
    of = lambda t: "".join(f"{t}.{k}, " for k in keys.split())
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, {own}c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r{"".join(", " + k for k in keys.split())} ORDER BY d, c) AS nth FROM (SELECT v.r, {of("v")}c.c, {_APART} AS d FROM v JOIN c{i} c ON {same})
  ) WHERE nth = 1
)""")
        if i < n:
            join = " AND ".join(f"o.{k} = s.{k}" for k in ["c", *keys.split()])
            group = "".join(f"a.{k}, " for k in keys.split())
            out.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT {of("o")}o.c, coalesce(s.e, o.e) AS e FROM c{i} o LEFT JOIN (
    SELECT {own}c, list(floor(total / n) ORDER BY i) AS e FROM (
      SELECT {group}a.c, i, sum(v.e[i]) AS total, count(*) AS n FROM a{i} a JOIN v ON a.r = v.r{"".join(f" AND a.{k} = v.{k}" for k in keys.split())}, (SELECT unnest(range(1, (SELECT max(len(e)) FROM v) + 1)) AS i) GROUP BY ALL
    ) GROUP BY {own}c
  ) s ON {join}
)""")
    return ",\n".join(out)


#: Number, label, is it a phrase of the base, words.
TEMPLATES = """
  (0, 'mit', TRUE, 'mit license'),
  (1, 'apache', TRUE, 'apache license'),
  (2, 'gpl', TRUE, 'general public license'),
  (3, 'notice-mit', FALSE, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  (4, 'notice-mit', FALSE, 'released under the mit license'),
  (5, 'notice-apache', FALSE, 'licensed under the apache license version 2 0'),
  (6, 'notice-gpl', FALSE, 'this work is licensed under the gnu general public license version 3'),
  (7, 'notice-gpl', FALSE, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  (8, 'notice-bsd', FALSE, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (9, 'notice-cc-by-nc', FALSE, 'licensed under cc by nc 4 0')
"""

ORACLES = {
    "op1_license_scan": rf"""
WITH w(t, label, base, w) AS (SELECT t, label, base, string_split(words, ' ') FROM (VALUES {TEMPLATES}) AS v(t, label, base, words)),
t AS (SELECT t, label, base, len(w) - 1 AS need, place, w[place + 1] AS a, w[place + 2] AS b FROM (SELECT *, unnest(range(len(w) - 1)) AS place FROM w)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (
  SELECT rid, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT rid, w, unnest(range(len(w) - 1)) AS p FROM d)
), v AS (
  SELECT rid, t, label, base, need, place, p - place AS diagonal FROM g JOIN t USING (a, b)
), x AS (
  SELECT rid, t, label, base, need, diagonal, count(DISTINCT place) AS votes FROM v GROUP BY ALL
), near AS (
  SELECT x.*, v.place, v.place + v.diagonal AS word,
         row_number() OVER (PARTITION BY x.rid, x.t, x.diagonal, v.place ORDER BY abs(v.diagonal - x.diagonal), v.diagonal) AS nth
  FROM x JOIN v ON x.rid = v.rid AND x.t = v.t AND v.diagonal BETWEEN x.diagonal - 2 AND x.diagonal + 2
), chain AS (
  SELECT *, max(word) OVER (PARTITION BY rid, t, diagonal ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM near WHERE nth = 1
), m AS (
  SELECT rid, label, diagonal, base AND votes = need AS place, count(*) FILTER (before IS NULL OR word > before) / need AS cover, NOT base AND cover >= 0.6 AS notice
  FROM chain GROUP BY rid, t, label, base, need, votes, diagonal
)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (m.place) AS n_base,
       (min(m.diagonal) FILTER (m.place))::BIGINT AS first_word, (max(m.diagonal) FILTER (m.place))::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label) FILTER (m.place), '') AS base_labels,
       coalesce(string_agg(DISTINCT m.label, ',' ORDER BY m.label) FILTER (m.place OR m.notice), '') AS labels,
       coalesce(max(CASE WHEN m.place THEN 1.0::DOUBLE WHEN m.notice THEN m.cover END), 0)::DOUBLE AS score
FROM d LEFT JOIN m ON d.rid = m.rid GROUP BY d.rid, d.doc_id
""",
    "op3_exact_top_k": f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE {_FINITE}
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
""",
    "op8_nearest_neighbours": f"""
WITH u AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {_FINITE}
), v AS (
  SELECT r, vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS n FROM u
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (c.n * q.n) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND q.n > 0 AND c.n > 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
""",
    "op4_suffix_array_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
  SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d
), g AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s
  FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM n WHERE n >= 50)
), m AS (
  SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT g.doc_id, g.p, lag(g.p) OVER (PARTITION BY g.doc_id ORDER BY g.p) AS before
  FROM g JOIN m ON g.s = m.s AND m.least < g.doc_id
), run AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit
), span AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r
), edge AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM span
), kept AS (
  SELECT n.doc_id, n.n, count(e.a) AS n_spans, coalesce(sum(e.b - e.a), 0) AS n_removed,
         coalesce(string_agg(substr(n.h, 2 * e.from_ + 1, 2 * (e.a - e.from_)), '' ORDER BY e.a), '') || substr(n.h, 2 * coalesce(max(e.b), 0) + 1) AS k
  FROM n LEFT JOIN edge e ON n.doc_id = e.doc_id GROUP BY n.doc_id, n.n, n.h
)
SELECT doc_id, n AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
""",
    "op6_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), t AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, length(replace(replace(replace(text, '\\', '\\\\'), '<', '\\<'), '[', '\\['))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
      ELSE 19 + length(replace(replace(replace(replace(role, '\\', '\\\\'), '<', '\\<'), '[', '\\['), ']', '\\]')) END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id, alone
""",
    "op12_code_compression": f"""
WITH u AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, {_WHOLE} AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT r, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS e FROM u, (SELECT unnest(range(16)) AS p)
), c0 AS (
  SELECT p, r - 1 AS c, e FROM v WHERE r <= 64
), {_rounds(2, "p")}, coded AS (
  SELECT r, string_agg(printf('%02x', c::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ',' ORDER BY p, c)) FROM c2) AS codebooks_sha256
FROM u JOIN coded USING (r)
""",
    "op13_centroid_clustering": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 40)
), {_rounds(5, "")}
SELECT v.vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c5.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN v USING (r) JOIN c5 USING (c)
""",
}
