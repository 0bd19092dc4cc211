"""The graph of the domain tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators.graph import PropertyGraph
from ..operators.orphans import endpoint
from ..schema import entity_uid

NODE_COLS = ["uid", "label", "name", "file", "line_start", "line_end", "kind", "extraction_method", "description", "metadata", "source_text", "signature", "return_type", "parameters"]


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities and core entities with their uids."""
    both = table(spark, d, "entities").unionByName(table(spark, d, "core_entities"))
    return both.withColumn("uid", entity_uid()).where("uid is not null")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations with both ends given, read as references are read, redeliveries once."""
    r = table(spark, d, "relations").withColumns({"subject": endpoint(F.col("subject")), "object": endpoint(F.col("object"))})
    return r.where("subject <> '' and object <> ''").dropDuplicates(["relation_id"])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The last recorded version of every uid, if it is not deleted, and the chunks."""
    e = entities(spark, d).withColumns({"label": F.col("entity_type"), "file": F.col("source_file")})
    last = e.groupBy("uid").agg(F.max_by(F.struct(*NODE_COLS[1:], "deleted_at"), F.struct("ingested_at", "entity_id")).alias("row"))
    last = last.where("row.deleted_at is null").select("uid", *(f"row.{c}" for c in NODE_COLS[1:]))
    c = table(spark, d, "source_chunks").select("uid", F.lit("SourceChunk").alias("label"), F.col("source_file").alias("file")).distinct()
    return last.unionByName(c, allowMissingColumns=True)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge per type and ends, with the properties of the last relation."""
    r = relations(spark, d)
    row = F.struct("confidence", F.col("source_file").alias("file"), "line", "role", "metadata")
    kept = r.groupBy(F.col("predicate").alias("type"), F.col("subject").alias("start"), F.col("object").alias("end")).agg(F.max_by(row, F.struct("ingested_at", "relation_id")).alias("row"))
    return kept.select("type", "start", "end", "row.*")


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph(nodes(spark, d), edges(spark, d))


UID = """CASE WHEN entity_type IN ('KconfigOption', 'DTBinding') THEN entity_type || '|' || name
     WHEN entity_type IN ('Folder', 'SourceFile') THEN entity_type || '|' || source_file
     ELSE entity_type || '|' || source_file || '|' || name END"""
READ = "replace(trim({}, chr(9) || ' '), chr(92), '/')"
WITH = f"""WITH RECURSIVE ents AS (
  SELECT *, {UID} AS uid FROM entities UNION ALL BY NAME SELECT *, {UID} AS uid FROM core_entities),
rels AS (SELECT DISTINCT ON (relation_id) relation_id, {READ.format('subject')} AS subject, predicate, {READ.format('object')} AS object, confidence, source_file, line, role, metadata, ingested_at
  FROM relations WHERE {READ.format('subject')} <> '' AND {READ.format('object')} <> ''),
nodes AS (
  SELECT uid, entity_type AS label, name, source_file AS file, line_start, line_end, kind, extraction_method, description, metadata, source_text, signature, return_type, parameters
  FROM (SELECT * FROM ents WHERE uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ingested_at DESC, entity_id DESC) = 1) WHERE deleted_at IS NULL
  UNION ALL BY NAME SELECT DISTINCT uid, 'SourceChunk' AS label, source_file AS file FROM source_chunks),
edges AS (SELECT predicate AS type, subject AS s, object AS o, confidence, source_file AS file, line, role, metadata FROM rels
  QUALIFY row_number() OVER (PARTITION BY predicate, subject, object ORDER BY ingested_at DESC, relation_id DESC) = 1)
"""
