"""Which of several rows with one key stays. All rules are partial aggregations on the key: no sort, no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from ..schema import GLOBAL_TYPES, kind_priority


def _keep(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    row = F.struct(*df.columns)
    best = df.groupBy(*(k.alias(n) for k, n in zip(keys, names))).agg(F.max_by(row, order).alias("row"))
    return best.select("row.*")


def entity_key(fold=folded) -> list[Column]:
    """Type, folded name, and the file for all types but the global ones."""
    return [F.col("entity_type"), fold(F.col("name")), F.when(F.col("entity_type").isin(*GLOBAL_TYPES), F.lit("")).otherwise(F.col("source_file"))]


def best_entities(df: DataFrame, seq: Column) -> DataFrame:
    """The kind of highest priority wins, the first of equal ones."""
    return _keep(df, entity_key(), F.struct(kind_priority(F.col("kind")), -seq))


def last_relations(df: DataFrame, seq: Column) -> DataFrame:
    """The last row per subject, predicate, object and file wins."""
    return _keep(df, [F.col(c) for c in ("subject", "predicate", "object", "source_file")], F.struct(seq))


def surest(df: DataFrame, keys: list[str], confidence: str, seq: Column) -> DataFrame:
    """The row of highest confidence wins, the first of equal ones (rule of the older pipeline)."""
    return _keep(df, [F.col(k) for k in keys], F.struct(F.col(confidence), -seq))


def merged_edges(df: DataFrame, seq: Column) -> DataFrame:
    """Edges as a graph store merges them: one per subject, predicate and object, with the last properties."""
    return _keep(df, [F.col(c) for c in ("subject", "predicate", "object")], F.struct(seq))
