"""Tables of the linked corpus, in Spark and as SQL common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weaveline.operators.references import clean_reference
from weaveline.plans.tables import table
from weaveline.scratch import spread

MODEL = "hash-ngram-v1"

#: Present documents: an id's latest row, unless deleted or flagged.
DOCS = """
docs AS (
  SELECT id, title, content, lang, metadata, source_ref, doc_key FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC, doc_key DESC) AS rn FROM source_documents WHERE id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL AND NOT coalesce(is_excluded, false) AND NOT coalesce(is_generated, false) AND NOT coalesce(is_archived, false))"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    last = Window.partitionBy("id").orderBy(F.desc("arrived_at"), F.desc("doc_key"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        table(spark, sf, "source_documents")
        .filter("id is not null")
        .withColumn("rn", F.row_number().over(last))
        .filter((F.col("rn") == 1) & F.col("deleted_at").isNull() & ~flag("is_excluded") & ~flag("is_generated") & ~flag("is_archived"))
        .select("id", "title", "content", "lang", "metadata", "source_ref", "doc_key")
    )


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '#.*$', '', 's'), '^\s+|\s+$', '', 'g'), '^/+', ''), '\.md$', '')"

#: Distinct typed edges with clean ends.
LINKS = f"""
links AS (
  SELECT DISTINCT source, target, kind FROM (
    SELECT {_CLEAN.format("source_id")} AS source, {_CLEAN.format("target_id")} AS target, kind FROM relationships)
  WHERE source <> '' AND target <> '' AND kind IS NOT NULL)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    r = spread(table(spark, sf, "relationships").select("rel_id", "source_id", "target_id", "kind"), "rel_id")  # cleaning is all the work
    return r.select(clean_reference(F.col("source_id")).alias("source"), clean_reference(F.col("target_id")).alias("target"), "kind").filter("source is not null and target is not null and kind is not null").distinct()


#: Vectors of the main model with their document: an embedding's latest usable row for each chunk and view.
UNITS = f"""
units AS (
  SELECT unit, doc, view, v, tokens, chunk_id FROM (
    SELECT e.id AS unit, regexp_replace(c.file_path, '\\.md$', '') AS doc, e.view_name AS view, coalesce(c.token_count, 0) AS tokens, e.chunk_id,
      list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(e.embedding AS DOUBLE[]), lambda y: y * y)))) AS v,
      row_number() OVER (PARTITION BY e.chunk_id, e.view_name ORDER BY e.embedded_at DESC, e.id DESC) AS rn
    FROM chunk_vectors e JOIN search_chunks c ON c.chunk_id = e.chunk_id
    WHERE e.model = '{MODEL}' AND c.file_path IS NOT NULL AND len(e.embedding) = 96
      AND len(list_filter(e.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0)
  WHERE rn = 1)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    from weaveline.functions.vectors import normalize, usable

    e = usable(table(spark, sf, "chunk_vectors").filter(F.col("model") == MODEL), "embedding", 96)
    c = table(spark, sf, "search_chunks").filter("file_path is not null").select("chunk_id", "file_path", "token_count")
    last = Window.partitionBy("chunk_id", "view_name").orderBy(F.desc("embedded_at"), F.desc("id"))
    return (
        e.join(c, "chunk_id")
        .withColumn("rn", F.row_number().over(last))
        .filter("rn = 1")
        .select(F.col("id").alias("unit"), F.regexp_replace("file_path", r"\.md$", "").alias("doc"), F.col("view_name").alias("view"), normalize(F.col("embedding")).alias("v"), F.coalesce("token_count", F.lit(0)).alias("tokens"), "chunk_id")
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
