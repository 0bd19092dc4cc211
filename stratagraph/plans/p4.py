"""Queries of problem 4, references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table, union_all
from ..operators import orphans as O


def _tables(spark: SparkSession, d: str):
    return table(spark, d, "relations"), [table(spark, d, "entities"), table(spark, d, "core_entities")], table(spark, d, "source_chunks")


def _orphans(spark: SparkSession, d: str):
    return O.orphans(*_tables(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)[0].select("relation_id", "endpoint").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_orphans(spark, d)[0])


def p4_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pending references at the end of the last slice."""
    last = _orphans(spark, d)[1][-1]
    return last.select("predicate", "kind", "pending")


def p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Pending references at the end of every month."""
    return O.pending_by_month(*_tables(spark, d))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_pending": p4_pending, "p4_snapshots": p4_snapshots}

_UID = """CASE WHEN entity_type IN ('KconfigOption', 'DTBinding') THEN entity_type || '|' || name
     WHEN entity_type IN ('Folder', 'SourceFile') THEN entity_type || '|' || source_file
     ELSE entity_type || '|' || source_file || '|' || name END"""
_BASE = f"""
WITH lives AS (
  SELECT {_UID} AS uid, ingested_at AS a, deleted_at AS z FROM entities
  UNION SELECT {_UID}, ingested_at, deleted_at FROM core_entities
  UNION SELECT uid, ingested_at, NULL FROM source_chunks),
r AS (SELECT DISTINCT relation_id, subject, object, predicate, ingested_at AS moment FROM relations),
refs AS (
  SELECT relation_id, 'subject' AS endpoint, replace(trim(subject, chr(9) || ' '), chr(92), '/') AS uid, predicate, moment FROM r
  UNION ALL SELECT relation_id, 'object', replace(trim(object, chr(9) || ' '), chr(92), '/'), predicate, moment FROM r),
named AS (SELECT * FROM refs WHERE uid <> '' AND NOT starts_with(uid, 'external:'))
"""
_MISSING = "SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.uid = n.uid AND l.a <= n.moment AND (l.z IS NULL OR l.z > n.moment))"
SQL = {
    "p4_found": f"{_BASE} SELECT relation_id, endpoint FROM ({_MISSING})",
    "p4_counts": f"{_BASE} SELECT predicate, split_part(uid, '|', 1) AS kind, strftime(moment, '%Y-%m') AS month, count(*) AS orphans FROM ({_MISSING}) GROUP BY 1, 2, 3",
    "p4_pending": f"""{_BASE} SELECT predicate, split_part(uid, '|', 1) AS kind, count(*) AS pending FROM named n
WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.uid = n.uid AND l.z IS NULL) GROUP BY 1, 2""",
    "p4_snapshots": f"""{_BASE}, dated AS (SELECT moment AS t FROM named UNION SELECT a FROM lives WHERE uid IS NOT NULL AND (z IS NULL OR z > a)
  UNION SELECT z FROM lives WHERE uid IS NOT NULL AND z > a),
months AS (SELECT DISTINCT date_trunc('month', t) AS m, date_trunc('month', t) + INTERVAL 1 MONTH AS e FROM dated WHERE t IS NOT NULL)
SELECT strftime(m, '%Y-%m') AS month, predicate, split_part(uid, '|', 1) AS kind, count(*) AS pending FROM months JOIN named n ON n.moment < e OR n.moment IS NULL
WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.uid = n.uid AND l.a < e AND (l.z IS NULL OR l.z >= e)) GROUP BY 1, 2, 3""",
}
