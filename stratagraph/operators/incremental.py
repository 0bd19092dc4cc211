"""Content-hash refresh: what changed, what stays, what goes. The goal: an update gives what a full run gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import file_of


def diff_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_file, status): added, removed, modified or unchanged."""
    both = old.select("source_file", F.col("sha256_hash").alias("a")).join(new.select("source_file", F.col("sha256_hash").alias("b")), "source_file", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged")
    return both.select("source_file", status.alias("status"))


def changed(diff: DataFrame) -> DataFrame:
    return diff.where("status <> 'unchanged'").select("source_file").distinct()


def untouched_relations(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Relations that none of the files touches: neither as their provenance nor as the file of an end."""
    keys = ["source_file", "subject_file", "object_file"]
    out = relations.withColumn("subject_file", file_of(F.col("subject"))).withColumn("object_file", file_of(F.col("object")))
    for k in keys:
        out = out.join(files.select(F.col("source_file").alias(k)).distinct(), k, "left_anti")
    return out.select(*relations.columns)


def merge_unchanged(old: DataFrame, new: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old rows of unchanged files whose key no new row has. Folders and files are always new."""
    kept = old.join(files.select("source_file").distinct(), "source_file", "left_anti")
    if "entity_type" in old.columns:
        kept = kept.where("entity_type not in ('Folder', 'SourceFile')")
    return new.unionByName(kept.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns))


def stale(existing: DataFrame, current: DataFrame, key: str = "uid") -> DataFrame:
    return existing.select(key).distinct().join(current.select(key).distinct(), key, "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the files that are gone leave, with every edge at one of them."""
    left = nodes.join(gone.select(F.col("source_file").alias("file")).distinct(), "file", "left_anti")
    alive = left.select("uid")
    kept = edges.join(alive.withColumnRenamed("uid", "start"), "start", "left_semi").join(alive.withColumnRenamed("uid", "end"), "end", "left_semi")
    return left, kept.select(*edges.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Copy on write: old rows without a new row of their key, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)
