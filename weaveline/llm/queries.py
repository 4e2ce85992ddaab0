"""Queries of problems 1 to 3 and 5 to 8 over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weaveline.llm import consensus, contamination, nearduplicates, neighbors, packing, readability, split
from weaveline.plans.tables import table

ANSWERS = {"tier": ["a", "b", "c", "d"], "target_correct": ["true", "false"], "anchor_natural": ["true", "false"]}


def p1_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_items(table(spark, sf, "search_chunks"), "chunk_id", "text", "start_char")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.oversized(p1_split(spark, sf), "chunk_id")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "source_documents").select(F.lit("document").alias("kind"), F.col("doc_key").alias("key"), F.col("content").alias("text"))
    chunks = table(spark, sf, "search_chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text")
    return documents.unionByName(chunks)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = nearduplicates.near_duplicates(_records(spark, sf), width=3, threshold=0.6, measure="set", least_words=50)
    return nearduplicates.expanded_pairs(links, members).withColumnRenamed("kind", "record_kind")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    links, members = nearduplicates.near_duplicates(_records(spark, sf), width=3, threshold=0.6, measure="set", least_words=50)
    return nearduplicates.groups(links, members)


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "audit_items").select(F.col("id").alias("item")).distinct()
    votes = consensus.latest_votes(table(spark, sf, "audit_labels"), "item_id", "annotator", list(ANSWERS), "labeled_at", "label_id", ANSWERS)
    return consensus.materialize(votes.join(items, "item", "left_semi"), "votes")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    votes = _votes(spark, sf)
    return consensus.consensus(votes, consensus.reliability(votes)).select(F.col("item").alias("item_id"), F.col("field").alias("field_name"), "answer")


def p3_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.agreement(_votes(spark, sf))


def p3_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.reliability(_votes(spark, sf))


def p5_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.nearest(table(spark, sf, "chunk_vectors"), "id", "embedding", ["view_name", "model"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.similar_pairs(p5_neighbors(spark, sf), "id", 0.85)


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p6_assignment(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaked_items(_leaks(spark, sf), "item_id")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    documents, graded = table(spark, sf, "documents"), table(spark, sf, "graded_samples")
    model = readability.fit_levels(graded, "sample_id", "text", "grade")
    passages = readability.graded_texts(graded, "sample_id", "text")
    languages = readability.fit_languages(documents, "doc_id", "text", "lang", {"en": passages})
    return readability.reading_levels(documents, "doc_id", "text", model, languages=languages)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "grade")


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    return readability.level_profile(_levels(spark, sf), table(spark, sf, "documents"), "doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_split, p2_found, p2_groups, p3_found, p3_agreement, p3_reliability, p5_found, p5_neighbors, p6_assignment, p6_fill, p7_found, p7_items, p8_found, p8_profile)
}

_VECTORS = """
WITH usable AS (
  SELECT id, view_name, model, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ranked AS (
  SELECT a.id, b.id AS neighbor, round(list_cosine_similarity(a.v, b.v), 12) AS cosine,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS rank
  FROM usable a JOIN usable b ON a.view_name IS NOT DISTINCT FROM b.view_name AND a.model IS NOT DISTINCT FROM b.model AND a.id <> b.id)
"""

ORACLE = {
    # without compatibility normalization, which this SQL lacks
    "p7_found": r"""WITH RECURSIVE bare AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
w AS (SELECT side, id, regexp_extract_all(lower(regexp_replace(text, '[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM bare),
g AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM w WHERE len(w) >= 12)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.gram = i.gram""",
    "p5_found": _VECTORS + "SELECT DISTINCT least(id, neighbor) AS id_a, greatest(id, neighbor) AS id_b FROM ranked WHERE rank <= 5 AND cosine >= 0.85",
    "p1_found": r"""
SELECT chunk_id FROM search_chunks
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]')) > 250""",
    "p2_found": r"""
WITH records AS (
  SELECT 'document' AS record_kind, doc_key AS key, content AS text FROM source_documents
  UNION ALL SELECT 'chunk', chunk_id, text FROM search_chunks),
words AS (SELECT record_kind, key, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM records WHERE text IS NOT NULL),
sets AS (
  SELECT record_kind, key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM words WHERE len(w) >= 50),
posts AS (SELECT record_kind, key, len(s) AS n, unnest(s) AS t FROM sets),
rare AS (SELECT record_kind, t FROM posts GROUP BY ALL HAVING count(*) > 1),
both_in AS (
  SELECT a.record_kind, a.key AS key_a, b.key AS key_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM posts a JOIN rare USING (record_kind, t) JOIN posts b ON a.record_kind = b.record_kind AND a.t = b.t AND a.key < b.key
  WHERE least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY ALL)
SELECT record_kind, key_a, key_b FROM both_in WHERE c >= 0.6 * (na + nb - c)""",
    "p3_agreement": r"""
WITH sheets AS (
  SELECT item_id, lower(trim(annotator)) AS annotator, lower(trim(tier)) AS tier, target_correct, anchor_natural,
    row_number() OVER (PARTITION BY item_id, lower(trim(annotator)) ORDER BY labeled_at DESC, label_id DESC) AS rn
  FROM audit_labels WHERE trim(annotator) <> '' AND item_id IN (SELECT id FROM audit_items)),
votes AS (
  SELECT item_id, 'tier' AS field, tier AS answer FROM sheets WHERE rn = 1
  UNION ALL SELECT item_id, 'target_correct', CAST(target_correct AS VARCHAR) FROM sheets WHERE rn = 1
  UNION ALL SELECT item_id, 'anchor_natural', CAST(anchor_natural AS VARCHAR) FROM sheets WHERE rn = 1),
cells AS (SELECT field, item_id, answer, count(*)::DOUBLE AS n FROM votes WHERE answer IS NOT NULL GROUP BY ALL),
units AS (SELECT field, item_id, sum(n) AS m, sum(n * n) AS sq FROM cells GROUP BY ALL HAVING sum(n) > 1),
seen AS (SELECT field, count(*) AS n_units, sum(m) AS total, sum((m * m - sq) / (m - 1)) AS apart FROM units GROUP BY field),
chance AS (
  SELECT field, sum(n * n) AS sq FROM (
    SELECT field, answer, sum(n) AS n FROM cells JOIN units USING (field, item_id) GROUP BY ALL) GROUP BY field)
SELECT field, n_units, CAST(total AS BIGINT) AS n_ratings, apart / total AS observed,
  (total * total - sq) / (total * (total - 1)) AS expected,
  CASE WHEN total * total = sq THEN 1.0 ELSE 1 - (apart / total) / ((total * total - sq) / (total * (total - 1))) END AS alpha
FROM seen JOIN chance USING (field)""",
}
