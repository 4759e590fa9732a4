"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import bpe, jaccard, language, lines, merkle, metric, mixing, negatives, pages, sharding, spelling, substrings, token_files
from scorewright.plans.staging import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf)).select("doc_id", "n_shingles", "component_id")


@query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/ids-{uuid4().hex}"
    manifest = token_files.write(documents(spark, sf), folder, vocabulary("word_bpe_49k.json"))
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    # the decoded text takes the place of the text, which need not come back
    coded = bpe.round_trip(documents(spark, sf).select("doc_id", "text"), path, decoded="text")
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", sharding.row_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(documents(spark, sf).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.remove_repeats(documents(spark, sf).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return metric.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op10_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.compare_edited(documents(spark, sf))


@query
def op11_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "url", "text", "n_chars")


@query
def op12_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    return negatives.hard_negatives(vectors.select("vec_id", negatives.shifted_labels(F.col("vec_id"), F.col("label")).alias("label"), "embedding"))


@query
def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(documents(spark, sf), every=199)


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


ORACLE["op7_substrings"] = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM docs WHERE len(w) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1:i + 20], ' ') ORDER BY doc_id, i) AS k FROM starts),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM ranked WHERE k > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

ORACLE["op9_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT link.y, reach.c FROM reach JOIN link ON link.x = reach.x),
least AS (SELECT x, min(c) AS c FROM reach GROUP BY x)
SELECT x AS vec_id, (SELECT count(*) FROM link WHERE link.x = least.x) AS n_links, c AS component_id, c = x AS kept FROM least"""

ORACLE["op8_lines"] = """
WITH docs AS (SELECT doc_id, text, CASE WHEN coalesce(length(text), 0) = 0 THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
places AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM docs),
windows AS (SELECT doc_id, i, 2 AS w, l[i + 1:i + 2] AS v FROM places WHERE i + 2 <= len(l)
  UNION ALL SELECT doc_id, i, 1, l[i + 1:i + 1] FROM places WHERE len(regexp_extract_all(l[i + 1], '[^\\x20\\x09-\\x0D]+')) >= 5),
ranked AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY w, v ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(w)) AS i FROM ranked WHERE k > 1),
kept AS (SELECT doc_id, string_agg(l[i + 1], chr(10) ORDER BY i) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(l)::BIGINT - coalesce(n, 0) AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

ORACLE["op12_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) IS NOT FALSE),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""
