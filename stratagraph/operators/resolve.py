"""Resolution joins: from references as written to records, with what stays open reported and never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import AMBIGUITY, UNRESOLVED
from .symbols import pick_unique, target_kind_of


def suffix_index(files: DataFrame) -> DataFrame:
    """(tail, n, source_file) of every tail of every path; source_file is the only path with that tail, else null."""
    tails = files.select("source_file").distinct().select("source_file", F.explode(paths.suffixes(F.col("source_file"))).alias("tail"))
    return tails.groupBy("tail").agg(F.count("*").alias("n"), F.max("source_file").alias("only")).select("tail", "n", F.when(F.col("n") == 1, F.col("only")).alias("only"))


def resolve_includes(pending: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``resolved``: the file next to the including one, else the exact path, else the only path with that tail."""
    known = files.select(F.col("source_file").alias("hit")).distinct()
    here = paths.normal(F.concat_ws("/", F.regexp_replace(F.col("source_file"), "/?[^/]*$", ""), F.col("target")))
    rows = pending.withColumn("near", here).withColumn("tail", paths.normal(F.col("target")))
    near = known.select(F.col("hit").alias("near"), F.col("hit").alias("near_hit"))
    exact = known.select(F.col("hit").alias("target"), F.col("hit").alias("exact_hit"))
    # a tail equal to a whole path is the exact match; a proper tail must be the only one
    only = suffix_index(files).select("tail", "only")
    out = rows.join(near, "near", "left").join(exact, "target", "left").join(only, "tail", "left")
    return out.withColumn("resolved", F.coalesce("near_hit", "exact_hit", "only")).drop("near", "near_hit", "exact_hit", "only", "tail")


def resolve_files(pending: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``resolved``: the exact path, else the only path with that tail."""
    known = files.select(F.col("source_file").alias("target"), F.col("source_file").alias("exact_hit")).distinct()
    only = suffix_index(files).select(F.col("tail").alias("target"), "only")
    return pending.join(known, "target", "left").join(only, "target", "left").withColumn("resolved", F.coalesce("exact_hit", "only")).drop("exact_hit", "only")


def _edge(subject, predicate, obj, confidence, source_file, line, rationale, role="", metadata=None) -> list[Column]:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [
        as_col(subject).alias("subject"), as_col(predicate).alias("predicate"), as_col(obj).alias("object"), as_col(confidence).cast("double").alias("confidence"), as_col(source_file).alias("source_file"),
        as_col(line).cast("int").alias("line"), as_col(rationale).alias("rationale"), as_col(role).alias("role"), as_col(metadata if metadata is not None else "{}").alias("metadata"),
    ]


def file_of(uid: Column) -> Column:
    """The file in a uid; null where it has none."""
    return F.get(F.split(uid, "\\|"), F.lit(1))


def resolve_calls(pending: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and base classes -> (edges, unresolved). Names without any candidate are library names and leave no row."""
    rows = pending.where("pend_kind in ('call', 'extends')")
    kind = F.when(F.col("pend_kind") == "extends", "typelike").otherwise("function")
    rows = rows.select("subject", "target", F.col("source_file").alias("file"), "line", F.when(F.col("pend_kind") == "extends", "EXTENDS").otherwise("CALLS").alias("predicate"), kind.alias("target_kind"), text.folded(F.col("target")).alias("key"))
    met = pick_unique(rows, symbols)
    sure = F.when(file_of(F.col("target_uid")) == F.col("file"), 1.0).otherwise(0.8)
    edges = met.where("status = 'ok'").select(*_edge(F.col("subject"), F.col("predicate"), F.col("target_uid"), sure, F.col("file"), F.col("line"), "unique candidate by name"))
    open_ = met.where("status = 'ambiguous'").select("subject", "predicate", F.col("target").alias("object"), F.col("file").alias("source_file"), "line", F.lit("several candidates").alias("reason"), "candidate_count")
    return edges, open_


def resolve_phandles(pending: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devicetree references by label -> (edges, unresolved, ambiguities)."""
    labels = pending.where("pend_kind = 'label'").select(F.lit("label").alias("target_kind"), F.col("target").alias("key"), F.col("subject").alias("uid"), F.col("source_file").alias("file"), F.lit(3).alias("priority")).distinct()
    refs = pending.where("pend_kind = 'phandle'").select("subject", "target", F.col("source_file").alias("file"), "line", "role", F.lit("label").alias("target_kind"), F.col("target").alias("key"))
    met = pick_unique(refs, labels)
    edges = met.where("status = 'ok'").select(*_edge(F.col("subject"), "REFERENCES", F.col("target_uid"), 1.0, F.col("file"), F.col("line"), "label", F.col("role")))
    open_ = met.where("status = 'ambiguous'").select("subject", F.lit("REFERENCES").alias("predicate"), F.col("target").alias("object"), F.col("file").alias("source_file"), "line", F.lit("several nodes with that label").alias("reason"), "candidate_count")
    missing = met.where("status = 'none'").select(F.col("target").alias("entity_name"), F.lit("DTNode").alias("entity_type"), F.col("file").alias("source_file"), F.col("line").alias("line_number"), F.lit("no node with that label").alias("reason"))
    return edges, open_, missing


def resolve_compatibles(pending: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compatible strings -> (edges, ambiguities), by the exact name of a binding."""
    refs = pending.where("pend_kind = 'compatible'").select("subject", "target", "source_file", "line")
    names = entities.where("entity_type = 'DTBinding'").select(F.col("name").alias("target"), F.col("uid").alias("hit")).dropDuplicates(["target"])
    met = refs.join(names, "target", "left")
    edges = met.where("hit is not null").select(*_edge(F.col("subject"), "COMPATIBLE_WITH", F.col("hit"), 1.0, F.col("source_file"), F.col("line"), "exact compatible"))
    missing = met.where("hit is null").select(F.col("target").alias("entity_name"), F.lit("DTBinding").alias("entity_type"), "source_file", F.col("line").alias("line_number"), F.lit("no binding for this compatible").alias("reason"))
    return edges, missing


def resolve_docs(pending: DataFrame, symbols: DataFrame, entities: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of documents by role -> (edges, ambiguities)."""
    refs = pending.where("pend_kind = 'docref'").withColumn("target_kind", target_kind_of(F.col("role"))).where("target_kind is not null")
    refs = refs.select("subject", "target", "source_file", "line", "role", "target_kind")
    bare = F.regexp_replace(F.col("target"), r"\(\)$", "")
    named = refs.where("target_kind in ('function', 'typelike', 'symbol')").withColumns({"key": text.folded(bare), "file": F.col("source_file")})
    a = pick_unique(named, symbols).select("subject", "target", "source_file", "line", "role", F.when(F.col("status") == "ok", F.col("target_uid")).alias("hit"))
    options = entities.where("entity_type = 'KconfigOption'").select(F.col("name").alias("option"), F.col("uid").alias("hit")).dropDuplicates(["option"])
    b = refs.where("target_kind = 'kconfig'").withColumn("option", text.strip_config(F.split("target", "=")[0])).join(options, "option", "left").select("subject", "target", "source_file", "line", "role", "hit")
    c = resolve_files(refs.where("target_kind = 'file'"), files)
    c = c.select("subject", "target", "source_file", "line", "role", F.when(F.col("resolved").isNotNull(), F.concat(F.lit("SourceFile|"), "resolved")).alias("hit"))
    anchors = pending.where("pend_kind = 'anchor'").groupBy(text.folded(F.col("target")).alias("anchor")).agg(F.max_by("subject", F.struct("source_file", "line")).alias("hit"))  # the last one wins
    d = refs.where("target_kind = 'anchor'").withColumn("anchor", text.folded(F.col("target"))).join(anchors, "anchor", "left").select("subject", "target", "source_file", "line", "role", "hit")
    met = a.unionByName(b).unionByName(c).unionByName(d)
    edges = met.where("hit is not null").select(*_edge(F.col("subject"), "REFERENCES", F.col("hit"), 1.0, F.col("source_file"), F.col("line"), "reference role", F.col("role")))
    missing = met.where("hit is null").select(F.col("target").alias("entity_name"), F.lit("Reference").alias("entity_type"), "source_file", F.col("line").alias("line_number"), F.concat(F.lit("no unique target for role "), "role").alias("reason"))
    return edges, missing


def satisfies(requirements: DataFrame, references: DataFrame) -> DataFrame:
    """Range join inside a file: requirement windows (uid, source_file, win_start, win_end) and resolved references (object, source_file, line)."""
    w = requirements.select(F.col("subject").alias("requirement"), "source_file", "win_start", "win_end")
    hit = references.select("source_file", "line", "object").join(w, "source_file").where("line between win_start and win_end")
    return hit.select(*_edge(F.col("requirement"), "SATISFIES", F.col("object"), 0.9, F.col("source_file"), F.col("line"), "reference inside the requirement's paragraph"))


def labelled_edges(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the labels of both ends, edges skipped because an end is unknown)."""
    named = nodes.select("uid", "label")
    both = relations.join(named.withColumnsRenamed({"uid": "subject", "label": "start_label"}), "subject", "left")
    both = both.join(named.withColumnsRenamed({"uid": "object", "label": "end_label"}), "object", "left")
    known = F.col("start_label").isNotNull() & F.col("end_label").isNotNull()
    return both.where(known), both.where(~known)


def stub_options(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Uids of options that edges name and no record declares: the stubs to create."""
    named = relations.where("object like 'KconfigOption|%'").select(F.col("object").alias("uid")).distinct()
    return named.join(entities.select("uid"), "uid", "left_anti").select("uid", F.substring_index("uid", "|", -1).alias("name"))


EMPTY_SHAPES = {"ambiguities": AMBIGUITY, "unresolved": UNRESOLVED}
