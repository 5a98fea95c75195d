"""The contract queries opN_<name>: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5).select("doc_id", "held_out", "score", "predicted")


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.sharding import shard_documents

    rows = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.common import stored
    from grovewise.llm.maxscore import quantised, top_k

    vectors = stored(quantised(table(spark, sf_dir, "embeddings")), "maxscore-vectors")
    found = top_k(vectors, vectors.where("id % 50 = 0"), k=5)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.crosspolytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.minhash import near_documents

    return near_documents(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.tokencount import count_tokens
    from grovewise.llm.tokens import vocabulary_path

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), limit=512)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.kneserney import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.packing import pack_documents
    from grovewise.llm.tokens import vocabulary_path

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), capacity=4096, closing=2)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op11_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.chatformat import conversation_digests, format_conversations

    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return conversation_digests(format_conversations(turns))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.common import stored
    from grovewise.llm.hardnegatives import hard_negatives, labelled_vectors

    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    rows = stored(labelled_vectors(moved), "pivot-vectors")
    found = hard_negatives(rows, rows.where("id % 100 = 0"), positives=5, negatives=10, low=30, high=90)
    scores = (F.col(c).cast("long").alias(c) for c in ("positive_score", "negative_score"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", *scores)


def op13_whiten_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grovewise.llm.whitening import integer_vectors, whitened_components

    return whitened_components(integer_vectors(table(spark, sf_dir, "embeddings")), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_toxicity_lexicon, op3_shard_documents, op4_maxscore_topk, op5_near_vectors, op6_near_documents, op7_count_tokens, op8_kneser_ney, op9_pack_documents, op10_mix_sources, op11_format_chats, op12_hard_negatives, op13_whiten_vectors)}
ORACLE_SQL: dict[str, str] = {
    "op11_format_chats": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(replace(role, '\\', '\\\\'), '<turn>', '\\<turn>'), '<text>', '\\<text>'), '</turn>', '\\</turn>') AS r,
                   replace(replace(replace(replace(text, '\\', '\\\\'), '<turn>', '\\<turn>'), '<text>', '\\<text>'), '</turn>', '\\</turn>') AS x FROM t
        ), f AS (SELECT *, '<turn>' || r || '<text>' || x || '</turn>' || chr(10) AS formatted FROM e)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, formatted), '')) AS loss_sha256,
               sum(length(formatted))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op4_maxscore_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id, score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op6_near_documents": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN
                list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            WHERE 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """,
    "op5_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)
    """,
}
