"""Full and incremental builds: files -> records -> resolved graph.

The extractors run once; their tagged rows are written (checkpointed) and feed every branch. References are kept as a
table of their own and resolved over all files every time, so an update gives the same graph as a full run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, union_all
from ..extract.dispatch import extract
from ..operators import chunking, dedup, incremental, metrics, resolve, store
from ..operators.graph import PropertyGraph
from ..operators.symbols import symbol_table
from ..sources import inventory

ENTITY_COLS = ["uid", "name", "entity_type", "source_file", "line_start", "line_end", "kind", "extraction_method", "description", "metadata", "source_text", "signature", "return_type", "parameters"]
RELATION_COLS = ["subject", "predicate", "object", "confidence", "source_file", "line", "rationale", "role", "metadata"]
PENDING_COLS = ["pend_kind", "subject", "target", "source_file", "line", "role", "win_start", "win_end"]
AMBIGUITY_COLS = ["entity_name", "entity_type", "source_file", "line_number", "reason"]


@dataclass
class Build:
    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    pending: DataFrame
    ambiguities: DataFrame
    unresolved: DataFrame
    extracted: DataFrame

    def graph(self) -> PropertyGraph:
        nodes = store.node_rows(self.entities)
        made = self.chunks.select("uid", F.lit("SourceChunk").alias("label"), F.col("source_file").alias("file"), F.col("source_file").alias("path"), "line_start", "line_end", F.col("content").alias("text"))
        return PropertyGraph(nodes.unionByName(made, allowMissingColumns=True), store.edge_rows(dedup.merged_edges(self.relations, F.col("line"))))


def _final_uids(relations: DataFrame, all_entities: DataFrame, winners: DataFrame) -> DataFrame:
    """Ends that name a record which lost to one of another spelling move to the winner."""
    key = lambda df: df.select("uid", F.concat_ws("|", *(k for k in dedup.entity_key())).alias("ekey"))
    best = key(winners).withColumnRenamed("uid", "winner")
    moved = key(all_entities).distinct().join(best, "ekey").where("uid <> winner").select("uid", "winner")
    out = relations
    for end in ("subject", "object"):
        m = moved.select(F.col("uid").alias(end), F.col("winner").alias(f"{end}_winner"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce(f"{end}_winner", end)).drop(f"{end}_winner")
    return out.select(*relations.columns)


def build(files: DataFrame, extracted: DataFrame | None = None) -> Build:
    """Everything from a table of files (source_file, content, language, size_bytes, sha256_hash, bucket, line_count)."""
    rows = cut(extract(files)) if extracted is None else extracted
    # order of emission: by path, then as the file's rows came; the first or last row of a key depends on it
    seq = F.concat(F.col("source_file"), F.lit("\x00"), F.lpad(F.col("seq").cast("string"), 9, "0"))
    found = rows.where("rec = 'entity'").select(*ENTITY_COLS, seq.alias("order"))
    folder = inventory.folders(files)
    fixed = union_all([
        inventory.file_entities(files).select("*", F.lit("").alias("kind"), F.lit("").alias("description")),
        folder.select(F.concat(F.lit("Folder|"), "source_file").alias("uid"), "name", F.lit("Folder").alias("entity_type"), "source_file", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("filesystem-walk").alias("extraction_method"), F.to_json(F.struct(F.concat(F.lit("Folder|"), "parent").alias("parent_uid"))).alias("metadata"), F.lit("").alias("kind"), F.lit("").alias("description")),
    ])
    entities = cut(_first_best(found).unionByName(fixed, allowMissingColumns=True).select(*ENTITY_COLS))
    pending = rows.where("rec = 'pending'").select(*PENDING_COLS)
    symbols = cut(symbol_table(entities))

    includes = resolve.resolve_includes(pending.where("pend_kind = 'include'"), files)
    imports = resolve.resolve_includes(pending.where("pend_kind = 'import'").withColumn("module", F.col("target")).withColumn("target", F.concat(F.replace("target", F.lit("."), F.lit("/")), F.lit(".py"))), files)
    inc = includes.where("resolved is not null").select(*resolve._edge(F.col("subject"), "INCLUDES", F.concat(F.lit("SourceFile|"), "resolved"), 1.0, F.col("source_file"), F.col("line"), "include"))
    imp = imports.select(*resolve._edge(F.col("subject"), "INCLUDES", F.coalesce(F.concat(F.lit("SourceFile|"), "resolved"), F.concat(F.lit("external:"), "module")), F.when(F.col("resolved").isNull(), 0.5).otherwise(1.0), F.col("source_file"), F.col("line"), "import"))
    missing_include = includes.where("resolved is null").select(F.col("target").alias("entity_name"), F.lit("SourceFile").alias("entity_type"), "source_file", F.col("line").alias("line_number"), F.lit("include not found").alias("reason"))
    calls, open_calls = resolve.resolve_calls(pending, symbols)
    phandles, open_handles, missing_labels = resolve.resolve_phandles(pending)
    compatible, missing_bindings = resolve.resolve_compatibles(pending, entities)
    docs, missing_docs = resolve.resolve_docs(pending, symbols, entities, files)
    satisfied = resolve.satisfies(pending.where("pend_kind = 'window'"), docs)
    contained = inventory.contains_edges(files).select(*resolve._edge(F.col("subject"), "CONTAINS", F.col("object"), 1.0, F.substring_index("object", "|", -1), F.lit(1), "file tree"))
    direct = rows.where("rec = 'relation'").select(*RELATION_COLS)
    all_edges = union_all([direct, contained, inc, imp, calls, phandles, compatible, docs, satisfied])
    all_edges = _final_uids(all_edges, found.select("uid", "name", "entity_type", "source_file"), entities)
    relations = cut(dedup.last_relations(all_edges, F.col("line")))

    noted = rows.where("rec = 'ambiguity'").select(F.col("name").alias("entity_name"), "entity_type", "source_file", F.col("line_start").alias("line_number"), "reason")
    ambiguities = union_all([noted, missing_include, missing_labels, missing_bindings, missing_docs, metrics.stub_sweep(entities)]).select(*AMBIGUITY_COLS)
    made = chunking.chunks(files)
    return Build(entities, relations, made, pending, ambiguities, open_calls.unionByName(open_handles), rows)


def _first_best(found: DataFrame) -> DataFrame:
    """Highest priority wins, then the first in order of path and emission."""
    best = found.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(dedup.entity_key()))).agg(
        F.min_by(F.struct(*ENTITY_COLS), F.struct(-dedup.kind_priority(F.col("kind")), "order")).alias("row")
    )
    return best.select("row.*")


def update(files: DataFrame, old_manifest: DataFrame, old_rows: DataFrame) -> tuple[Build, DataFrame]:
    """Incremental build: only added and modified files are parsed; the rest of the tagged rows are those of the last run.

    References stay rows of their own, so they are resolved again over everything, which is cheap next to parsing.
    """
    diff = cut(incremental.diff_manifest(old_manifest, files.select("source_file", "sha256_hash")))
    parse = files.join(diff.where("status in ('added', 'modified')").select("source_file"), "source_file", "left_semi")
    kept = old_rows.join(incremental.changed(diff), "source_file", "left_anti")
    rows = cut(kept.select(*old_rows.columns).unionByName(extract(parse)))
    return build(files, rows), diff
