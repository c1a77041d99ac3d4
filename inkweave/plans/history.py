"""The version history query (problem 5) and its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkweave.operators.history import versions
from inkweave.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return versions(table(spark, d, "translation_history"), "unit_id", ["revision", "status"], "updated_at", "line_no")


ORACLE = {
    "p5_found": """
WITH d AS (
  SELECT unit_id, updated_at, arg_max(revision, line_no) AS revision, arg_max(status, line_no) AS status
  FROM translation_history WHERE updated_at IS NOT NULL GROUP BY unit_id, updated_at),
f AS (
  SELECT *, lag(revision) OVER w AS r0, lag(status) OVER w AS s0, row_number() OVER w AS rn
  FROM d WINDOW w AS (PARTITION BY unit_id ORDER BY updated_at)),
v AS (
  SELECT unit_id, revision, status, epoch_us(updated_at) AS valid_from_us
  FROM f WHERE rn = 1 OR r0 IS DISTINCT FROM revision OR s0 IS DISTINCT FROM status)
SELECT unit_id, revision, status, valid_from_us,
  coalesce(lead(valid_from_us) OVER (PARTITION BY unit_id ORDER BY valid_from_us), -1) AS valid_to_us
FROM v"""
}
