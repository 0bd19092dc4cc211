"""Running questions safely: read-only statements, row caps, timeouts, hidden records."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS, MAX_SECONDS = 100, 30
#: Logical plans that only read; everything the parser turns into another kind of plan is refused.
_COMMANDS = ("Command", "Create", "Drop", "Insert", "Merge", "Delete", "Update", "Alter", "Replace", "Truncate", "Set", "Reset", "Add", "Analyze", "Cache", "Uncache", "Refresh", "Repair", "Load", "Call", "Execute")


class NotReadOnly(ValueError):
    pass


def check_read_only(spark: SparkSession, statement: str) -> None:
    """Refuses what the parser does not take for a query: by the plan, not by words inside names or strings."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    name = plan.getClass().getSimpleName()
    if any(name.startswith(c) or name.endswith("Command") for c in _COMMANDS):
        raise NotReadOnly(f"{name} is no query")


def ask(spark: SparkSession, statement: str, rows: int = MAX_ROWS, seconds: float = MAX_SECONDS) -> list[dict]:
    """Rows of a read-only statement, at most so many and within so many seconds."""
    check_read_only(spark, statement)
    sc, group = spark.sparkContext, f"ask-{threading.get_ident()}"
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, statement[:80], interruptOnCancel=True)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in spark.sql(statement).limit(rows).collect()]
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def without_internal(nodes: DataFrame, column: str = "kind") -> DataFrame:
    """Leaves out records marked internal; unmarked ones stay."""
    return nodes.where(F.coalesce(F.col(column), F.lit("")) != "internal")


def prefiltered(nodes: DataFrame, language: str | None = None, file_pattern: str | None = None, label: str | None = None) -> DataFrame:
    """Structured filters before any search: language from the metadata, a pattern on the path, a label."""
    out = nodes
    if label:
        out = out.where(F.col("label") == label)
    if file_pattern:
        out = out.where(F.col("file").rlike(file_pattern))
    if language:
        out = out.where(F.get_json_object("metadata", "$.language") == language)
    return out
