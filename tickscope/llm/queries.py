"""One query per operator of this package, over whole tables, and SQL where it can express one."""

from __future__ import annotations

from tickscope.llm import (
    byte_bpe, chat_format, lexical, line_dedup, near_dup, neighbours, packing, pii, quality, shards, token_counts,
    toxicity, whitening,
)
from tickscope.llm.common import apply_runtime_settings, documents
from tickscope.llm.token_counts import PATTERN


def op1_weak_supervision_pii(spark, sf):
    return pii.pii_table(documents(spark, sf))


def op2_best_fit_packing(spark, sf):
    return packing.pack_documents(documents(spark, sf))


def op3_projected_neighbours(spark, sf):
    return neighbours.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op4_minhash_near_dedup(spark, sf):
    return near_dup.near_dup_table(documents(spark, sf))


def op5_token_counts(spark, sf):
    return token_counts.token_counts(documents(spark, sf), token_counts.gpt_file())


def op6_byte_level_bpe(spark, sf):
    return byte_bpe.encode_decode(documents(spark, sf), byte_bpe.gpt_ranks(), PATTERN)


def op7_quality_divergence(spark, sf):
    return quality.quality_table(documents(spark, sf))


def op8_toxic_spans(spark, sf):
    return toxicity.toxicity_table(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op9_kd_shards(spark, sf):
    return shards.shard_table(documents(spark, sf))


def op10_line_dedup(spark, sf):
    return line_dedup.line_dedup_table(documents(spark, sf))


def op11_pair_bound_maxscore(spark, sf):
    return lexical.ranked(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op12_jacobi_whitening(spark, sf):
    return whitening.whitened(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_chat_round_trip(spark, sf):
    return chat_format.chat_table(spark.read.parquet(f"{sf}/conversations.parquet"))


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def _prepared(query):
    def run(spark, sf):
        return query(apply_runtime_settings(spark), sf)

    return run


QUERIES = {q.__name__: _prepared(q) for q in (
    op1_weak_supervision_pii, op2_best_fit_packing, op3_projected_neighbours, op4_minhash_near_dedup,
    op5_token_counts, op6_byte_level_bpe, op7_quality_divergence, op8_toxic_spans, op9_kd_shards,
    op10_line_dedup, op11_pair_bound_maxscore, op12_jacobi_whitening, op13_chat_round_trip, pipeline)}

ORACLES = {
    "op10_line_dedup": """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM rows),
keyed AS (
    SELECT r, doc_id, line, pos,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key
    HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY k.r, k.doc_id
""",
    "op11_pair_bound_maxscore": """
WITH folded AS (
    SELECT doc_id, row_number() OVER () AS d,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, len(ts) AS n FROM folded WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
tf AS MATERIALIZED (
    SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM docs) GROUP BY d, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(t.docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, total t GROUP BY term),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
uses AS (SELECT item_id, term, count(*) AS uses FROM asked GROUP BY item_id, term),
impacts AS (
    SELECT d, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * t.docs) // t.terms))) AS impact
    FROM tf JOIN docs USING (d) JOIN weights USING (term), total t),
scores AS (
    SELECT item_id, d, sum(uses * impact)::BIGINT AS score FROM uses JOIN impacts USING (term)
    GROUP BY item_id, d HAVING sum(uses * impact) > 0),
ranked AS (
    SELECT item_id, doc_id, score,
           row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
    FROM scores JOIN docs USING (d))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""",
    "op13_chat_round_trip": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
spelled AS (
    SELECT *, CASE role WHEN 'system' THEN '<<SYS>>  <</SYS>>' WHEN 'user' THEN '[INST]  [/INST]'
                        WHEN 'assistant' THEN '<s>  </s>' ELSE '<<ROLE>> ' || role || ' <<TEXT>>  <</ROLE>>' END AS marks,
           regexp_replace(regexp_replace(text, '(<)(\\*(s>|/s>|<SYS>>|</SYS>>|<ROLE>>|<TEXT>>|</ROLE>>))', '\1\\\2', 'g'),
                          '(\[)(\\*(INST\]|/INST\]))', '\1\\\2', 'g') AS escaped
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
           AS loss_sha256,
       sum(length(marks) + length(escaped) + 1)::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id
""",
}
