"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import scratch_path, table, tokenizer_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import with_edits

    return with_edits(table(spark, sf_dir, "documents"))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import dedup_spans

    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    index = round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_time")  # archives' names differ from run to run


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jpeg import read_texts, store_texts

    return read_texts(store_texts(table(spark, sf_dir, "documents")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs["doc_id"])))
    return identify(docs.withColumn("held_out", held_out(docs["doc_id"])), model, ["doc_id", "held_out"])


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import expand, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], turns.schema)
    return read_back(expand(turns.unionByName(more)), in_order=True)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import link

    return link(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_syncmer_fingerprints, op3_sentence_spans, op4_warc, op5_packing, op6_progressive_jpeg, op7_sentencepiece, op8_language, op9_chat_format, op10_ngram_jaccard)}
#: Results that SQL can express; tests hold the others against brute force or the public libraries.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        q AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
        FROM r""",
    "op9_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t),
        f AS (
            SELECT *, role = 'assistant' AS reply, length('### : </turn>') + 1 + 2 * length(role) - length(regexp_replace(role, '[\\#<:\n]', '', 'g'))
                + 2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')) AS n FROM c
        ),
        s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(CASE WHEN reply THEN i ELSE 0 END) OVER (PARTITION BY conv_id) AS final FROM f)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (reply), '')) AS loss_sha256,
            CAST(coalesce(sum(upto) FILTER (reply), 0) + coalesce(sum(n) FILTER (i > final), 0) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (reply) AS BIGINT) AS n_examples
        FROM s GROUP BY conv_id""",
}
