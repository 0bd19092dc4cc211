"""Counts, sweeps and reports over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which properties a label must have, and which properties were indexed.
REQUIRED = {
    "Folder": ["uid", "path", "name"], "SourceFile": ["uid", "path", "name", "sha256_hash", "detected_type"], "Function": ["uid", "name", "file", "line_start", "kind"],
    "Class": ["uid", "name", "file", "line_start", "kind"], "Type": ["uid", "name", "file", "line_start", "kind"], "Macro": ["uid", "name", "file", "line_start", "kind"],
    "Variable": ["uid", "name", "file", "line_start"], "KconfigOption": ["uid", "name", "kind"], "DTNode": ["uid", "name", "file", "node_path"], "DTBinding": ["uid", "compatible"],
    "Document": ["uid", "path", "title"], "Concept": ["uid", "name", "file", "line_start"], "Requirement": ["uid", "text", "file", "line_start"],
    "SourceChunk": ["uid", "source_file", "line_start", "line_end", "content"],
}
INDEXES = [
    ("Folder", "uid"), ("SourceFile", "uid"), ("SourceFile", "path"), ("Function", "uid"), ("Function", "name"), ("Class", "uid"), ("Class", "name"), ("Type", "uid"), ("Macro", "uid"), ("Variable", "uid"),
    ("KconfigOption", "uid"), ("KconfigOption", "name"), ("DTNode", "uid"), ("DTBinding", "uid"), ("Document", "uid"), ("Document", "path"), ("Concept", "uid"), ("Requirement", "uid"), ("SourceChunk", "uid"), ("SourceChunk", "source_file"),
]
# Names that say nothing, and the types that count as cross links.
GENERIC_NAMES = ("config", "data", "temp", "buf", "handler", "manager")
CROSS_LINKS = ("DOCUMENTED_IN", "REFERENCED_IN", "SATISFIES")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("count"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("count"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge; folders may stand alone."""
    ends = edges.select(F.explode(F.array("start", "end")).alias("uid")).distinct()
    return nodes.where("label <> 'Folder'").join(ends, "uid", "left_anti")


def label_sets(edges: DataFrame) -> DataFrame:
    """(type, count, start_labels, end_labels) observed in labelled edges."""
    return edges.groupBy("type").agg(F.count("*").alias("count"), F.sort_array(F.collect_set("start_label")).alias("start_labels"), F.sort_array(F.collect_set("end_label")).alias("end_labels"))


def required_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUIRED.items()), "label string, required_properties array<string>")


def schema_nodes(nodes: DataFrame) -> DataFrame:
    """(label, count, required_properties); a label without an entry must have a name."""
    return label_counts(nodes).join(required_table(nodes.sparkSession), "label", "left").withColumn("required_properties", F.coalesce("required_properties", F.array(F.lit("name"))))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    """One row: high from 0.9, medium from 0.6, low from 0.4; below that uncounted."""
    c = F.col("confidence")
    return edges.agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.6) & (c < 0.9)).alias("medium"), F.count_if((c >= 0.4) & (c < 0.6)).alias("low"))


def cross_links(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("type").isin(*CROSS_LINKS)).alias("cross_links"))


def top_central(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes with most edge ends; ties by uid."""
    return edges.select(F.explode(F.array("start", "end")).alias("uid")).groupBy("uid").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "uid").limit(k)


def totals(entities: DataFrame, relations: DataFrame, ambiguities: DataFrame, unresolved: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return one(entities, "entities").unionByName(one(relations, "relations")).unionByName(one(ambiguities, "ambiguities")).unionByName(one(unresolved, "unresolved"))


def completeness(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files found, SourceFile nodes, and whether every file has its node."""
    found = files.select("source_file").distinct()
    have = nodes.where("label = 'SourceFile'").select(F.col("file").alias("source_file")).distinct()
    return found.join(have.withColumn("there", F.lit(1)), "source_file", "left").agg(F.count("*").alias("files"), F.count("there").alias("nodes"), (F.count("*") == F.count("there")).alias("complete"))


def verify_counts(exported: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, exported, stored) of both tables; a difference raises when the row is read."""
    a, b = exported.groupBy(key).agg(F.count("*").alias("exported")), stored.groupBy(key).agg(F.count("*").alias("stored"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("exported", F.lit(0)).alias("exported"), F.coalesce("stored", F.lit(0)).alias("stored"))
    wrong = F.raise_error(F.concat(F.lit("counts differ for "), F.col(key)))
    return both.withColumn("stored", F.when(F.col("exported") == F.col("stored"), F.col("stored")).otherwise(wrong))


def distinct_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many labels and edge types there are, and whether they are suspiciously few."""
    none = F.lit(None).cast("string")
    both = nodes.select("label", none.alias("type")).unionByName(edges.select(none.alias("label"), "type"))
    return both.agg(F.countDistinct("label").alias("labels"), F.countDistinct("type").alias("types")).select("labels", "types", (F.col("labels") < 5).alias("few_labels"), (F.col("types") < 8).alias("few_types"))


def _ambiguity(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select(F.col("name").alias("entity_name"), "entity_type", "source_file", F.col("line_start").alias("line_number"), F.lit(reason).alias("reason"))


def stub_sweep(entities: DataFrame) -> DataFrame:
    return _ambiguity(entities.where("entity_type = 'KconfigOption' and kind = 'stub'"), "referred to, never declared")


def generic_sweep(entities: DataFrame) -> DataFrame:
    return _ambiguity(entities.where(F.lower("name").isin(*GENERIC_NAMES)), "generic name")


def unsure_sweep(relations: DataFrame, least: float = 0.6) -> DataFrame:
    return relations.where(F.col("confidence") < least)


def degree_zero_sweep(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities whose name is the end of no relation (relations by name, as the older pipeline has them)."""
    ends = relations.select(F.explode(F.array(F.substring_index("subject", "|", -1), F.substring_index("object", "|", -1))).alias("name")).distinct()
    return _ambiguity(entities.join(ends, "name", "left_anti"), "no relation names it")


def long_uncommented(functions: DataFrame, lines: int = 100, window: int = 8000) -> DataFrame:
    """Functions of more than so many lines whose first characters hold no comment line."""
    head = F.substring("source_text", 1, window)
    n = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return functions.where((n > lines) & ~head.rlike(r"(?m)^\s*(?://|/\*|\*|#)"))
