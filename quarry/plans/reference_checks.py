"""Queries on broken references (problem 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.references import orphan_references, reference_faults
from quarry.storage import table


def _faults(spark: SparkSession, d: str) -> DataFrame:
    skill = table(spark, d, "skill")
    gone = F.col("is_active") == 0
    sugg = table(spark, d, "skill_suggestion").select(F.lit("skill_suggestion").alias("table_name"), F.col("id").alias("row_id"), F.col("canonical_skill_id").alias("key"), "loaded_at")
    kind = F.lower(F.trim("entity_type"))
    queue = table(spark, d, "review_queue").where(kind.isin("block", "skill")).select(F.lit("review_queue").alias("table_name"), F.col("id").alias("row_id"), F.col("entity_id").alias("key"), "loaded_at", kind.alias("kind"))
    to_skill = sugg.unionByName(queue.where("kind = 'skill'").drop("kind"))
    to_block = queue.where("kind = 'block'").drop("kind")
    return reference_faults(to_skill, ["key"], skill, ["id"], deleted=gone).unionByName(reference_faults(to_block, ["key"], table(spark, d, "source_block"), ["id"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _faults(spark, d).select("table_name", "row_id", "reason").distinct()


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    rows = _faults(spark, d).select("table_name", "row_id", "reason", F.date_format("loaded_at", "yyyy-MM").alias("month")).distinct()
    return rows.groupBy("table_name", "month", "reason").agg(F.count("*").alias("orphans"))


def p4_composite_partial(spark: SparkSession, d: str) -> DataFrame:
    """(nearest_name, canonical_skill_id) against (canonical_name, id) under MATCH PARTIAL."""
    sugg = table(spark, d, "skill_suggestion").select("id", "nearest_name", "canonical_skill_id")
    return orphan_references(sugg, ["nearest_name", "canonical_skill_id"], table(spark, d, "skill"), ["canonical_name", "id"], "partial")


QUERIES = {"p4_found": p4_found, "p4_by_month": p4_by_month, "p4_composite_partial": p4_composite_partial}

_FAULTS = """
WITH refs AS (
  SELECT 'skill_suggestion' AS table_name, id AS row_id, 'skill' AS kind, canonical_skill_id AS key, loaded_at FROM skill_suggestion
  UNION ALL
  SELECT 'review_queue', id, lower(trim(entity_type)), entity_id, loaded_at FROM review_queue WHERE lower(trim(entity_type)) IN ('block', 'skill')
), targets AS (
  SELECT 'skill' AS kind, id AS key, min(CASE WHEN is_active = 0 THEN 1 ELSE 0 END) AS gone, min(loaded_at) AS there FROM skill GROUP BY id
  UNION ALL
  SELECT 'block', id, 0, min(loaded_at) FROM source_block GROUP BY id
), faults AS (
  SELECT DISTINCT r.table_name, r.row_id, strftime(r.loaded_at, '%Y-%m') AS month,
         CASE WHEN t.key IS NULL THEN 'missing' WHEN t.gone = 1 THEN 'deleted' WHEN t.there > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets t ON t.kind = r.kind AND t.key = r.key WHERE r.key IS NOT NULL
)
"""

SQL = {
    "p4_found": _FAULTS + "SELECT DISTINCT table_name, row_id, reason FROM faults WHERE reason IS NOT NULL",
    "p4_by_month": _FAULTS + "SELECT table_name, month, reason, count(*) AS orphans FROM faults WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_composite_partial": """
SELECT s.id, s.nearest_name, s.canonical_skill_id,
       CAST((CASE WHEN s.nearest_name IS NULL THEN 1 ELSE 0 END) + (CASE WHEN s.canonical_skill_id IS NULL THEN 2 ELSE 0 END) AS INTEGER) AS null_mask
FROM skill_suggestion s
WHERE (s.nearest_name IS NOT NULL OR s.canonical_skill_id IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM skill k WHERE (s.nearest_name IS NULL OR s.nearest_name = k.canonical_name) AND (s.canonical_skill_id IS NULL OR s.canonical_skill_id = k.id))
""",
}
