"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import (
    alignment, cotraining, fingerprints, graph_index, lexical_search, mixing, packing, page_crf, passage_dedup,
    pivot_search, pseudonyms, simhash, toxicity,
)
from gradeloom.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: For the test tables only; a real corpus brings its own secret.
PSEUDONYM_KEY = "key of the test tables"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_phrase_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, folder, "documents"))


@query
def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components(table(spark, folder, "documents"))


@query
def op6_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op3_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, key=PSEUDONYM_KEY)


@query
def op5_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_dedup.deduplicated(table(spark, folder, "documents"))


@query
def op8_clause_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_crf.extracted(table(spark, folder, "pages"))


@query
def op10_temperature_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).drop("text")


@query
def op7_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph_index.nearest(table(spark, folder, "embeddings"))


@query
def op2_cotrained_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment.aligned(docs, packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("piece_bpe_32k.model"))


@query
def op12_sketch_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op12_sketch_search"] = r"""
WITH cut AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), held AS (
    SELECT doc_id, term, count(*) AS tf FROM cut GROUP BY ALL
), sizes AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, whole GROUP BY term
), scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id), whole
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""


@query
def op13_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_search.exact_nearest(table(spark, folder, "embeddings"))


ORACLES["op13_pivot_search"] = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
    FROM whole q JOIN whole v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores
QUALIFY rank <= 20
"""
