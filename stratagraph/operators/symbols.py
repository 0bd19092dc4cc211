"""References by name: the unique candidate, or none.

The rule: no candidate - none; one candidate - it; exactly one in the referring file - it; else among those of the
referring file (or all, if it has none) the one of strictly highest priority; else the reference is ambiguous.

Candidates are summed up per name and per name and file before anything is joined, so a reference meets two rows,
however many candidates its name has; a name that every file refers to never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from ..schema import kind_priority


def symbol_table(entities: DataFrame) -> DataFrame:
    """(target_kind, key, uid, file, priority) of everything that can be referred to by name."""
    kind = F.when(F.col("entity_type") == "Function", "function").when(F.col("entity_type").isin("Class", "Type", "Macro"), "typelike")
    rows = entities.withColumn("target_kind", kind).where("target_kind is not null")
    rows = rows.select("target_kind", folded(F.col("name")).alias("key"), "uid", F.col("source_file").alias("file"), kind_priority(F.col("kind")).alias("priority")).distinct()
    return rows.unionByName(rows.withColumn("target_kind", F.lit("symbol")))


def _summary(symbols: DataFrame, keys: list[str], tag: str) -> DataFrame:
    per = symbols.groupBy(*keys, "priority").agg(F.count("*").alias("n"), F.max("uid").alias("uid"))
    top = F.max(F.struct("priority", F.col("n").alias("ties"), "uid"))
    return per.groupBy(*keys).agg(F.sum("n").alias(f"n_{tag}"), top.alias(f"top_{tag}"))


def pick_unique(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds candidate_count, status (ok, none or ambiguous) and target_uid to references (target_kind, key, file, ...)."""
    everywhere = _summary(symbols, ["target_kind", "key"], "all")
    here = _summary(symbols, ["target_kind", "key", "file"], "file")
    met = pending.join(everywhere, ["target_kind", "key"], "left").join(here, ["target_kind", "key", "file"], "left")
    n, m = F.coalesce("n_all", F.lit(0)), F.coalesce("n_file", F.lit(0))
    pool = F.when(m > 0, F.col("top_file")).otherwise(F.col("top_all"))
    chosen = F.when(n == 1, F.col("top_all")["uid"]).when(m == 1, F.col("top_file")["uid"]).when(pool["ties"] == 1, pool["uid"])
    status = F.when(n == 0, "none").when(chosen.isNotNull(), "ok").otherwise("ambiguous")
    return met.withColumns({"candidate_count": n, "status": status, "target_uid": chosen}).drop("n_all", "n_file", "top_all", "top_file")


def target_kind_of(role: Column) -> Column:
    """What a reference role of a document names; null for roles that are skipped."""
    # The reference roles.
    kinds = {
        "c:func": "function", "cpp:func": "function", "c:function": "function", "c:struct": "typelike", "c:type": "typelike", "c:macro": "typelike", "c:enum": "typelike", "c:union": "typelike",
        "c:enumerator": "typelike", "cpp:type": "typelike", "cpp:struct": "typelike", "option": "kconfig", "kconfig:option": "kconfig", "file": "file", "ref": "anchor", "code-span": "symbol",
    }
    out = F.lit(None).cast("string")
    for k, v in kinds.items():
        out = F.when(role == k, v).otherwise(out)
    return out
