"""Queries over the document tables, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import round_trip
from gridloom.llm.chroma import align, as_recordings, fingerprints, with_excerpts
from gridloom.llm.conversation_repair import damaged, repair_report
from gridloom.llm.cotraining import classify
from gridloom.llm.lexical_search import search
from gridloom.llm.mixing import mix
from gridloom.llm.ngram_join import ngram_join
from gridloom.llm.piece_bpe import piece_round_trip
from gridloom.llm.pii import personal_data
from gridloom.llm.quality_rules import quality
from gridloom.llm.quotation_links import as_mail, reply_conversations
from gridloom.llm.secret_scan import secret_scan
from gridloom.llm.token_counts import token_counts
from gridloom.sources.tables import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats sent as mail that quotes up to two turns; the links are found from the quotes alone."""
    return reply_conversations(as_mail(table(spark, sf_dir, "conversations")))


OP5_SQL = """
WITH told AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS body, lag(turn) OVER w AS parent_turn, row_number() OVER w AS n
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, turn, role, parent_turn, CAST(min(turn) OVER (PARTITION BY conv_id) AS BIGINT) AS root_turn,
       CAST(n - 1 AS BIGINT) AS depth, CAST(least(n - 1, 2) AS BIGINT) AS quote_levels, body
FROM told
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from the embeddings, with excerpts of some: the data has no audio of its own."""
    return align(fingerprints(as_recordings(with_excerpts(table(spark, sf_dir, "embeddings")))))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations, damaged first: they have no faults of their own."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH cut AS (
    SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
    UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark
),
terms AS (
    SELECT kind, row, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM cut
),
tf AS (SELECT row, id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL),
n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term
),
scores AS (
    SELECT i.row AS item, i.id AS item_id, tf.row AS doc, tf.id AS doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length)))) AS BIGINT) AS score
    FROM terms i JOIN tf USING (term) JOIN weights USING (term) JOIN n ON n.row = tf.row, totals
    WHERE i.kind = 'i' GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


def op13_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_token_counts": op4_token_counts,
    "op5_quotation_links": op5_quotation_links,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chroma_fingerprints": op8_chroma_fingerprints,
    "op9_personal_data": op9_personal_data,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_sentencepiece_round_trip": op13_sentencepiece_round_trip,
}
SQL: dict[str, str] = {"op5_quotation_links": OP5_SQL, "op12_lexical_search": OP12_SQL}
