"""Reading tables, cutting lineage, and small column helpers shared by all operators."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names; only where there is none (local tests) a folder of this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ignoring_case(c: Column) -> Column:
    return F.lower(c)


def trim_blank(c: Column) -> Column:
    """Without surrounding blanks, tabs and line ends."""
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def salted(df: DataFrame, salts: int, *by: str) -> DataFrame:
    """Adds a salt that is a function of the row's own columns, so a retried task makes the same one."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
