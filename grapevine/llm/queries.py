"""The operators as queries on the test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapevine.llm import (
    byte_bpe,
    curation_sql,
    hmm,
    language_id,
    merkle,
    middles,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    vector_graph,
    warc,
)
from grapevine.llm.rows import remainder
from grapevine.session import Workspace, use_small_batches, use_trial_folder

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> Workspace:
    use_trial_folder(spark)
    return Workspace(spark)


def text_workspace(spark: SparkSession) -> Workspace:
    """For the operators that the pipeline is made of, which hand whole texts to Python again and again."""
    use_small_batches(spark)
    return workspace(spark)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    return hmm.scored(_table(spark, sf_dir, "documents"), held_out, workspace(spark))


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = packing.packed(docs, public_tokenizers.path(WORD_TOKENIZER), text_workspace(docs.sparkSession))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(_table(spark, sf_dir, "embeddings"), workspace(spark)).drop("recall")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), workspace(spark)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept"]
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), text_workspace(spark)).select(*columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"), workspace(spark))


def quality_model(docs: DataFrame, sf_dir: str) -> quality_classifier.Model:
    use_small_batches(docs.sparkSession)
    labels = _table(docs.sparkSession, sf_dir, "labels")
    return quality_classifier.fit(docs, labels, remainder("doc_id", 4) != 2)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.scored(docs, quality_model(docs, sf_dir))
    good = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", good.alias("predicted")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), text_workspace(spark))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, remainder("doc_id", 3) != 1)
    return language_id.labelled(docs, model, "doc_id").select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tables = workspace(spark)
    made = merkle.manifest(_table(spark, sf_dir, "documents"), tables, seen={"text": tampered})
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256")
    return merkle.climbed(made, tables).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middles.transformed(_table(spark, sf_dir, "documents"))
    texts = {"output_sha256": F.col("output"), "restored_sha256": middles.restored(F.col("output"), F.col("form"))}
    digests = [F.sha2(text.cast("binary"), 256).alias(name) for name, text in texts.items()]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixture(_table(spark, sf_dir, "documents"), workspace(spark))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.planned(made).select("doc_id", "size", "source_size", "target", taken)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov_scores": op1,
    "op2_retrieval_packing": op2,
    "op3_pruned_vector_graph": op3,
    "op4_vector_bin_packing": op4,
    "op5_robust_outliers": op5,
    "op6_dictionary_archives": op6,
    "op7_hashed_ngram_quality": op7,
    "op8_similarity_sketches": op8,
    "op9_segment_tree_bpe": op9,
    "op10_language_spans": op10,
    "op11_merkle_climb": op11,
    "op12_rank_index_middles": op12,
    "op13_repeated_mixture": op13,
}

_COMPONENTS = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

ORACLE: dict[str, str] = {
    "op3_pruned_vector_graph": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
        good AS (
            SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
            AND len(list_filter(embedding, lambda v: v <> 0)) > 0
        ),
        links AS (
            SELECT p.id AS a, q.id AS b FROM good p JOIN good q ON p.label = q.label AND p.id <> q.id
            WHERE list_cosine_similarity(p.x, q.x) >= 0.98
        ),
        {_COMPONENTS},
        counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
        FROM least LEFT JOIN counts USING (id)
    """,
    "op6_dictionary_archives": """
        WITH sized AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        named AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last
            FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to
        FROM named
    """,
    "op8_similarity_sketches": rf"""
        WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
        worded AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM worded
        ),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        common AS (
            SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c
            FROM shingles p JOIN shingles q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id
            GROUP BY p.doc_id, q.doc_id
        ),
        links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
        {_COMPONENTS}
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN least ON doc_id = id
    """,
    "op11_merkle_climb": curation_sql.MERKLE,
    "op12_rank_index_middles": curation_sql.MIDDLES,
    "op13_repeated_mixture": curation_sql.MIXTURE,
}
