"""Writing a graph: Parquet as the primary store, JSON lines and JSON documents as exports."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_json, first_filled
from .incremental import upsert
from .metrics import INDEXES, label_sets, schema_nodes

LOGGERS = ("structural", "crosslink", "graph", "database")
ORDERS = {"entities": ["entity_type", "source_file", "name"], "relations": ["predicate", "subject", "object"], "source_chunks": ["uid"]}


def loggers() -> dict[str, logging.Logger]:
    return {n: logging.getLogger(f"stratagraph.{n}") for n in LOGGERS}


def node_rows(entities: DataFrame) -> DataFrame:
    """Entities as the graph stores them; ``text`` is the source text, else the description, else the name."""
    return entities.where("entity_type <> 'SourceChunk'").select(
        "uid", F.col("entity_type").alias("label"), "name", F.col("source_file").alias("file"), F.col("source_file").alias("path"), "line_start", "line_end", "kind", "extraction_method", "description",
        first_filled(F.col("source_text"), F.col("description"), F.col("name")).alias("text"), F.col("name").alias("title"), "source_text", "signature", "return_type", F.to_json("parameters").alias("parameters"), "metadata",
    )


def edge_rows(relations: DataFrame, strict: bool = True) -> DataFrame:
    """Relations as edges; strict raises on a predicate that is no upper-case name."""
    ok = F.col("predicate").rlike("^[A-Z][A-Z0-9_]*$")
    kind = F.when(ok, F.col("predicate")).otherwise(F.raise_error(F.concat(F.lit("bad predicate "), F.coalesce("predicate", F.lit("null"))))) if strict else F.when(ok, F.col("predicate"))
    return relations.select(kind.alias("type"), F.col("subject").alias("start"), F.col("object").alias("end"), "confidence", F.col("source_file").alias("file"), "line", "rationale", "role", "metadata")


def has_chunk_edges(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """SourceFile to SourceChunk, where the file is a node."""
    e = chunks.select(F.lit("HAS_CHUNK").alias("type"), F.concat(F.lit("SourceFile|"), "source_file").alias("start"), F.col("uid").alias("end")).distinct()
    return e.join(nodes.where("label = 'SourceFile'").select(F.col("uid").alias("start")), "start", "left_semi").select("type", "start", "end")


def export_records(df: DataFrame, kind: str, folder: str) -> None:
    """Totally ordered JSON lines with ASCII escapes, in as many parts as the sort makes."""
    rows = df.orderBy(*ORDERS[kind]).select(ascii_json(F.struct(*df.columns)).alias("value"))
    rows.write.mode("overwrite").text(f"{folder}/{kind}.jsonl")


def export_report(df: DataFrame, where: str) -> None:
    """A report {generated_at, count, items} as lines: a head line, then one line per item."""
    head = df.agg(F.count("*").alias("count")).select(F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), "count")).alias("value"))
    head.unionByName(df.select(F.to_json(F.struct(*df.columns)).alias("value"))).write.mode("overwrite").text(where)


def graph_schema(nodes: DataFrame, labelled: DataFrame) -> dict:
    """The observed schema; one row per label and type, so it is small by nature."""
    return {
        "node_labels": [r.asDict() for r in schema_nodes(nodes).orderBy("label").collect()],
        "relationship_types": [r.asDict() for r in label_sets(labelled).orderBy("type").collect()],
        "indexes_created": [{"label": a, "property": b} for a, b in INDEXES],
        "generated_at": datetime.now(timezone.utc).isoformat(),
    }


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Full load. Partitioned by label and type, which is what lookups select on; sorted by uid inside.

    The rows are rebalanced by label and type: adaptive execution makes as many files of each as its size asks for.
    """
    nodes.hint("rebalance", "label").sortWithinPartitions("uid").write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.hint("rebalance", "type").sortWithinPartitions("start").write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def append_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, folder: str, into: str) -> None:
    """Load without wiping: the stored rows, with those of equal key replaced, go to a new folder."""
    old_nodes, old_edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    write_graph(upsert(old_nodes, nodes, ["uid"]), upsert(old_edges, edges, ["type", "start", "end"]), into)


def run_suite(spark: SparkSession, questions: dict[str, Callable[[], DataFrame]], where: str, most: int = 100) -> DataFrame:
    """Runs every question and logs one record each; a failing question is recorded and the suite goes on."""
    now = lambda: datetime.now(timezone.utc).isoformat()
    log = [(now(), "suite_start", None, None, "ok", None)]
    for qid, ask in questions.items():
        try:
            rows = ask().limit(most).toJSON().collect() if hasattr(DataFrame, "toJSON") else []
            log.append((now(), "question", qid, json.dumps([json.loads(r) for r in rows]), "ok", None))
        except Exception as e:
            log.append((now(), "question", qid, None, "error", str(e)))
    log.append((now(), "suite_complete", None, None, "ok", None))
    df = spark.createDataFrame(log, "timestamp_utc string, operation string, question_id string, rows string, status string, error string")
    df.coalesce(1).write.mode("append").json(where)
    return df
