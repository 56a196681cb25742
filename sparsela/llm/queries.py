"""Registered queries: each derives the columns of its contract from the operator's output."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontamination, jaccard_join, language_id, lm_scoring, packing, quality_model, quality_rules, token_counts, toxicity
from .text import crc_mod, documents


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score(documents(spark, sf_dir)).withColumn("log_score", F.round("log_score", 5))


def op2_chat_formatting(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], talks.schema)
    return chat.digests(chat.format_chats(talks.unionByName(extra)))


def op3_decontamination(spark, sf_dir):
    return decontamination.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("containment", F.round("containment", 9))


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op6_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = language_id.train(docs.where("not held_out"))
    return language_id.identify(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)


def op7_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir))


def op9_quality_classifier(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    return quality_model.score(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)


def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_chat_formatting, op3_decontamination, op4_ngram_jaccard_join, op5_quality_rules, op6_language_id, op7_toxicity, op8_token_counts, op9_quality_classifier, op10_packing)}

ORACLE_SQL = {
    "op2_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(17 + length(role) + length(et)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS s
       FROM (SELECT item_id, w, least(5, len(w)) AS n FROM b WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS s
       FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n),
q AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (n, s) GROUP BY 1, 2)
SELECT doc_id, item_id, q.n AS n_item_shingles, shared AS n_shared, round(shared / q.n, 9) AS containment
FROM m JOIN q USING (item_id) WHERE shared >= greatest(1, ceil(q.n * 0.8 - 1e-9))""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) WHERE c > 1 GROUP BY 1),
ln AS (SELECT doc_id, source, text, line FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY 1),
nl AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
       len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM ln),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY 1),
often AS (SELECT source, h FROM (SELECT source, h, count(DISTINCT doc_id) AS c FROM nl GROUP BY 1, 2) JOIN hosts USING (source) WHERE c > 10 AND c > 0.01 * docs),
gone AS (SELECT doc_id, sum(n) AS n FROM nl JOIN often USING (source, h) GROUP BY 1),
base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM f""",
    "op1_lm_scoring": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS w FROM d),
g AS (SELECT doc_id, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT *,
  count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
  count(*) OVER (PARTITION BY w1, w) - count(*) OVER (PARTITION BY doc_id, w1, w) AS c2,
  count(*) OVER (PARTITION BY w2, w1, w) - count(*) OVER (PARTITION BY doc_id, w2, w1, w) AS c3,
  count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM g),
b AS (SELECT *, lag(c1) OVER o AS p1, lag(c2) OVER o AS p2 FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE
  WHEN i >= 2 AND c3 > 0 THEN ln(c3 / p2)
  WHEN i >= 1 AND c2 > 0 THEN ln(c2 / p1) + (least(i, 2) - 1) * ln(0.4::DOUBLE)
  ELSE ln((CASE WHEN c1 > 0 THEN c1 ELSE 0.4::DOUBLE END) / greatest(n, 1)) + least(i, 2) * ln(0.4::DOUBLE) END AS x FROM b)
SELECT doc_id, len(l) AS n_words, round(coalesce(t, 0), 5) AS log_score
FROM d LEFT JOIN (SELECT doc_id, sum(x) AS t FROM s GROUP BY 1) USING (doc_id)""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id,
  coalesce(any_value(l.n), 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id LEFT JOIN (SELECT x, count(*) FILTER (x <> y) AS n FROM e GROUP BY 1) l ON l.x = d.doc_id GROUP BY d.doc_id""",
}
