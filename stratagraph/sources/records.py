"""Reading what an earlier run exported: records as JSON lines, and the manifest of file hashes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..schema import CHUNK, ENTITY, RELATION

MANIFEST = "source_file string, sha256_hash string, size_bytes long"
SHAPES = {"entities": ENTITY, "relations": RELATION, "source_chunks": CHUNK}


def read_records(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Exported JSON lines of one kind; blank lines are skipped, missing fields are null."""
    return spark.read.schema(SHAPES[kind]).json(f"{folder}/{kind}.jsonl")


def read_manifest(spark: SparkSession, where: str) -> DataFrame:
    """The last manifest, or an empty one where there is none or it cannot be read."""
    try:
        found = spark.read.schema(MANIFEST).parquet(where)
        found.limit(1).count()
        return found
    except Exception as e:  # a corrupt manifest means a full run, not a failure
        if not isinstance(e, AnalysisException) and "parquet" not in str(e).lower():
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest_of(files: DataFrame) -> DataFrame:
    return files.select("source_file", "sha256_hash", "size_bytes").dropDuplicates(["source_file"])


def write_manifest(files: DataFrame, where: str) -> None:
    manifest_of(files).write.mode("overwrite").parquet(where)
