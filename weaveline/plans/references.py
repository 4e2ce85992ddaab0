"""Queries of problem 4: links between documents against the documents held at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weaveline.operators import references as R
from weaveline.plans.tables import table


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_references(
        table(spark, sf, "relationships"),
        table(spark, sf, "source_documents"),
        child_id="rel_id",
        sides={"source": "source_id", "target": "target_id"},
        recorded="recorded_at",
        parent_key="id",
        arrived="arrived_at",
        deleted="deleted_at",
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select(R.F.col("child_id").alias("rel_id"), "side")


def p4_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphans_by_period(_orphans(spark, sf))


def p4_dangling_ids(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_keys(_orphans(spark, sf)).select("side", "key", "n_refs")


QUERIES = {"p4_found": p4_found, "p4_by_month": p4_by_month, "p4_dangling_ids": p4_dangling_ids}

_CASES = r"""
WITH refs AS (
  SELECT rel_id, 'source' AS side, source_id AS raw, recorded_at FROM relationships
  UNION ALL SELECT rel_id, 'target', target_id, recorded_at FROM relationships),
clean AS (
  SELECT rel_id, side, recorded_at,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '#.*$', '', 's'), '^\s+|\s+$', '', 'g'), '^/+', ''), '\.md$', '') AS key
  FROM refs),
cases AS (
  SELECT c.*, CASE
      WHEN NOT EXISTS (SELECT 1 FROM source_documents d WHERE d.id = c.key AND d.arrived_at IS NOT NULL
        AND (d.deleted_at IS NULL OR d.deleted_at > d.arrived_at - INTERVAL 24 HOUR)) THEN 'missing'
      WHEN recorded_at IS NULL THEN 'untimed'
      WHEN EXISTS (SELECT 1 FROM source_documents d WHERE d.id = c.key AND d.arrived_at <= c.recorded_at + INTERVAL 24 HOUR
        AND d.deleted_at > d.arrived_at - INTERVAL 24 HOUR) THEN 'deleted'
      ELSE 'late' END AS reason
  FROM clean c WHERE key <> '' AND NOT EXISTS (
    SELECT 1 FROM source_documents d WHERE d.id = c.key AND d.arrived_at <= c.recorded_at + INTERVAL 24 HOUR
      AND (d.deleted_at IS NULL OR d.deleted_at > c.recorded_at)))
"""

ORACLE = {
    "p4_found": _CASES + "SELECT rel_id, side FROM cases",
    "p4_by_month": _CASES + "SELECT side, strftime(date_trunc('month', recorded_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS period, reason, count(*) AS n_refs FROM cases GROUP BY 1, 2, 3",
    "p4_dangling_ids": _CASES + "SELECT side, key, count(*) AS n_refs FROM cases GROUP BY 1, 2",
}
