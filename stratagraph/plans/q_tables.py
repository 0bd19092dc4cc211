"""Queries on files, chunks, references, snapshots, search and scalar functions; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import table
from ..extract.dispatch import extract
from ..functions import paths, text
from ..operators import chunking, incremental, legacy, metrics, resolve, retrieval
from ..operators.symbols import pick_unique, symbol_table
from ..sources import inventory
from .graphs import READ, UID, WITH, edges, entities, nodes, relations


def _files(s: SparkSession, d: str) -> DataFrame:
    """The inventory, every path once."""
    return table(s, d, "source_files").dropDuplicates(["source_file"])


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Files with the columns an inventory has."""
    f = _files(s, d).withColumn("language", paths.language(F.col("source_file")))
    binary = F.col("content").isNull()
    return f.withColumns({"bucket": paths.bucket(F.col("language"), F.col("source_file"), binary), "line_count": text.line_count(F.coalesce("content", F.lit("")), binary)})


def s01_folders(s, d):
    return inventory.folders(_files(s, d))


def s01_contains(s, d):
    return inventory.contains_edges(_files(s, d))


def s02_file_entities(s, d):
    return inventory.file_entities(_typed(s, d)).select("uid", "name", "line_end", F.get_json_object("metadata", "$.language").alias("language"), F.get_json_object("metadata", "$.extension").alias("extension"))


def s05_language(s, d):
    return _files(s, d).select("source_file", paths.language(F.col("source_file")).alias("language"))


def s06_bucket(s, d):
    return _typed(s, d).groupBy("bucket").agg(F.count("*").alias("files"))


def s07_sha256(s, d):
    return _files(s, d).where("content is not null").select("source_file", text.digest(F.col("content")).alias("sha256"))


def s08_line_count(s, d):
    return _typed(s, d).select("source_file", "line_count")


def s11_prefix(s, d):
    return inventory.in_scope(_files(s, d), "mesh-lab/").select("source_file", "size_bytes")


def s12_whitelist(s, d):
    return inventory.whitelisted(_files(s, d)).select("source_file")


def k01_chunks(s, d):
    return chunking.chunks(_files(s, d)).select("uid", "source_file", "line_start", "line_end", F.length("content").alias("chars"))


def k04_line_to_chunk(s, d):
    made = chunking.chunks(_files(s, d))
    e = entities(s, d).where("entity_type = 'Function'").select("entity_id", "source_file", "line_start").distinct()
    return chunking.chunk_of_line(e, made).select("entity_id", "source_chunk_uid")


def u04_fragment_sets(s, d):
    """Assignments of configuration fragments, wholly in the JVM; the last one of a key in a file wins."""
    f = _files(s, d).withColumn("language", paths.language(F.col("source_file"))).where("language = 'kconfig-fragment' and content is not null")
    lines = f.select("source_file", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")).alias("line", "text"))
    off = F.regexp_extract("text", r"^\s*#\s*CONFIG_([A-Z0-9_]+)\s+is not set\s*$", 1)
    name = F.regexp_extract("text", r"^\s*CONFIG_([A-Z0-9_]+)\s*=\s*(.+?)\s*$", 1)
    value = F.regexp_extract("text", r"^\s*CONFIG_([A-Z0-9_]+)\s*=\s*(.+?)\s*$", 2)
    rows = lines.select("source_file", "line", F.when(off != "", off).otherwise(name).alias("option"), F.when(off != "", F.lit("n")).otherwise(value).alias("value")).where("option <> ''")
    return rows.groupBy("source_file", "option").agg(F.max_by("value", "line").alias("value"))


def u08_headings(s, d):
    """Markdown headings with their level and line."""
    f = _files(s, d).where("content is not null").where(F.lower("source_file").rlike(r"\.(md|markdown)$"))
    lines = f.select("source_file", F.posexplode(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")).alias("n", "text"))
    marks = F.regexp_extract("text", r"^(#{1,6})[ \t]+(.+?)[ \t]*$", 1)
    return lines.select("source_file", (F.col("n") + 1).alias("line"), F.length(marks).alias("level"), F.regexp_extract("text", r"^(#{1,6})[ \t]+(.+?)[ \t]*$", 2).alias("title")).where("level > 0")


def u08_code_spans(s, d):
    f = _files(s, d).where("content is not null").where(F.lower("source_file").rlike(r"\.(md|markdown)$"))
    return f.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("`([^`\n]+)`"), F.lit(1)))).alias("span"))


def u10_requirements(s, d):
    """Sentences with a modal verb, of at least twelve characters; names are their first 180."""
    f = _files(s, d).where("content is not null").where(F.lower("source_file").rlike(r"\.(md|rst)$"))
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?i)[^.!?\n]*\b(?:shall|must|should|required to)\b[^.!?\n]*[.!?]"), F.lit(0)))
    rows = f.select("source_file", found.alias("text")).select("source_file", F.trim("text").alias("text")).where(F.length("text") >= 12)
    return rows.select("source_file", F.substring("text", 1, 180).alias("name")).distinct()


def _extracted(s, d):
    return extract(_typed(s, d))


def u01_python(s, d):
    return _extracted(s, d).where("rec = 'entity' and extraction_method = 'python-ast'").select("uid", "kind", "line_start", "line_end", "signature", "return_type")


def u02_c(s, d):
    return _extracted(s, d).where("rec = 'entity' and extraction_method = 'tree-sitter-c'").select("uid", "kind", "line_start", "line_end", "signature", "return_type")


def u03_kconfig(s, d):
    return _extracted(s, d).where("extraction_method = 'tree-sitter-kconfig' or predicate in ('DEPENDS_ON', 'SELECTS')").select("rec", "uid", "subject", "predicate", "object")


def u05_devicetree(s, d):
    return _extracted(s, d).where("extraction_method = 'tree-sitter-devicetree'").select("uid", "kind", "line_start", "line_end", F.get_json_object("metadata", "$.node_path").alias("node_path"))


def u06_bindings(s, d):
    return _extracted(s, d).where("extraction_method = 'pyyaml'").select("uid", "source_file")


def u07_rst(s, d):
    return _extracted(s, d).where("extraction_method = 'tree-sitter-rst'").select("uid", "entity_type", "kind", "line_start")


def u09_dispatch(s, d):
    return _extracted(s, d).groupBy("rec", "entity_type", "extraction_method", "predicate", "pend_kind").agg(F.count("*").alias("rows"))


def full_build(s, d):
    from . import pipeline

    b = pipeline.build(_typed(s, d))
    return b.entities.groupBy(F.lit("entity").alias("what"), F.col("entity_type").alias("type")).agg(F.count("*").alias("rows")).unionByName(
        b.relations.groupBy(F.lit("relation").alias("what"), F.col("predicate").alias("type")).agg(F.count("*").alias("rows"))
    ).unionByName(b.ambiguities.groupBy(F.lit("ambiguity").alias("what"), F.col("reason").alias("type")).agg(F.count("*").alias("rows"))).unionByName(
        b.unresolved.groupBy(F.lit("unresolved").alias("what"), F.col("predicate").alias("type")).agg(F.count("*").alias("rows")))


def _include_refs(s, d):
    f = _files(s, d).where("content is not null").where(F.col("source_file").rlike(r"\.(c|h|dts|dtsi|overlay)$"))
    return f.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'), F.lit(1)))).alias("target"))


def j01_includes(s, d):
    return resolve.resolve_includes(_include_refs(s, d), _files(s, d)).select("source_file", "target", "resolved")


def j02_file_references(s, d):
    refs = _include_refs(s, d).select("target").distinct()
    return resolve.resolve_files(refs, _files(s, d))


def _call_refs(s, d):
    r = relations(s, d).where("predicate = 'CALLS' and object like 'Function|%'")
    return r.select("relation_id", F.lit("function").alias("target_kind"), F.lower(text.last_field(F.col("object"))).alias("key"), resolve.file_of(F.col("subject")).alias("file"))


def j03_symbols(s, d):
    return symbol_table(entities(s, d)).groupBy("target_kind", "key").agg(F.count("*").alias("candidates"))


def j04_pick_unique(s, d):
    return pick_unique(_call_refs(s, d), symbol_table(entities(s, d))).select("relation_id", "candidate_count", "status", "target_uid")


def j07_compatibles(s, d):
    r = relations(s, d).where("predicate = 'COMPATIBLE_WITH'")
    pending = r.select(F.lit("compatible").alias("pend_kind"), "subject", text.last_field(F.col("object")).alias("target"), "source_file", "line")
    found, missing = resolve.resolve_compatibles(pending, entities(s, d))
    return found.select("subject", "object").distinct().withColumn("found", F.lit(True)).unionByName(missing.select(F.lit(None).cast("string").alias("subject"), F.col("entity_name").alias("object"), F.lit(False).alias("found")).distinct())


def j09_document_roles(s, d):
    """References of rST documents by role to functions, types and options."""
    f = _files(s, d).where("content is not null and source_file like '%.rst'")
    refs = f.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(":[A-Za-z][A-Za-z0-9_:+-]*:`[^`\n]+`"), F.lit(0)))).alias("ref"))
    refs = refs.select("source_file", F.regexp_extract("ref", "^:(.+):`([^`]+)`$", 1).alias("role"), F.regexp_extract("ref", "^:(.+):`([^`]+)`$", 2).alias("target"))
    from ..operators.symbols import target_kind_of

    refs = refs.withColumn("target_kind", target_kind_of(F.col("role"))).where("target_kind in ('function', 'typelike')")
    rows = refs.withColumns({"key": F.lower(F.regexp_replace("target", r"\(\)$", "")), "file": F.col("source_file")})
    return pick_unique(rows, symbol_table(entities(s, d))).select("source_file", "role", "target", "status", "target_uid")


def j09_all_roles(s, d):
    """References of reST and Markdown documents by every kind of role, code spans included; target_uid is null where nothing or several fit."""
    f = _typed(s, d)
    rows = extract(f.where("content is not null and language in ('rst', 'markdown')")).where("rec = 'pending'")
    e = entities(s, d)
    found, missing = resolve.resolve_docs(rows.select("pend_kind", "subject", "target", "source_file", "line", "role"), symbol_table(e), e, f)
    none = F.lit(None).cast("string")
    got = found.select("source_file", "line", "role", none.alias("target"), F.col("object").alias("target_uid"))
    lost = missing.select("source_file", F.col("line_number").alias("line"), F.regexp_extract("reason", "role (.+)$", 1).alias("role"), F.col("entity_name").alias("target"), none.alias("target_uid"))
    return got.unionByName(lost).distinct()


def j10_satisfies(s, d):
    """Requirements and the edges recorded near them: range join inside a file."""
    w = entities(s, d).where("entity_type = 'Requirement'").select(F.col("uid").alias("subject"), "source_file", (F.col("line_start") - 2).alias("win_start"), (F.col("line_end") + 2).alias("win_end")).distinct()
    refs = relations(s, d).where("predicate = 'REFERENCES'").select("source_file", "line", "object").distinct()
    return resolve.satisfies(w, refs).select("subject", "object", "line", "confidence").distinct()


def _snapshots(s, d):
    f = _files(s, d).select("file_id", "source_file", F.coalesce("sha256_hash", F.lit("none")).alias("sha256_hash"))
    old = f.where("file_id % 11 <> 0").withColumn("sha256_hash", F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("x"), "sha256_hash")).otherwise(F.col("sha256_hash")))
    return old.select("source_file", "sha256_hash"), f.where("file_id % 10 <> 0").select("source_file", "sha256_hash")


def j13_manifest_diff(s, d):
    return incremental.diff_manifest(*_snapshots(s, d))


def a21_changed_counts(s, d):
    return j13_manifest_diff(s, d).groupBy("status").agg(F.count("*").alias("files"))


def j14_untouched(s, d):
    gone = incremental.changed(j13_manifest_diff(s, d))
    return incremental.untouched_relations(relations(s, d), gone).select("relation_id")


def j15_merge_unchanged(s, d):
    gone = incremental.changed(j13_manifest_diff(s, d))
    e = entities(s, d).select("uid", "entity_type", "source_file").distinct()
    new = e.join(gone, "source_file", "left_semi").select("uid", "entity_type", "source_file")
    return incremental.merge_unchanged(e, new, gone, ["uid"])


def j16_stale_folders(s, d):
    a, b = _snapshots(s, d)
    return incremental.stale(inventory.folders(a), inventory.folders(b), "source_file")


def j17_delete_nodes(s, d):
    gone = incremental.changed(j13_manifest_diff(s, d))
    n, e = incremental.delete_nodes(nodes(s, d), edges(s, d), gone)
    one = lambda df, w: df.agg(F.count("*").alias("left")).select(F.lit(w).alias("what"), "left")
    return one(n, "nodes").unionByName(one(e, "edges"))


def so_sets(s, d):
    """Union, difference and intersection of paths of two snapshots."""
    a, b = (x.select("source_file") for x in _snapshots(s, d))
    tag = lambda df, w: df.distinct().agg(F.count("*").alias("n")).select(F.lit(w).alias("op"), "n")
    return tag(a.union(b), "union").unionByName(tag(a.exceptAll(b), "difference")).unionByName(tag(a.intersect(b), "intersection"))


def j18_mentions(s, d):
    n = entities(s, d).where("entity_type in ('Function', 'Class')").select("name")
    return legacy.mentions(_files(s, d).where("content is not null and source_file like '%.rst'"), n)


DOCUMENT_FILE = r"\.(rst|md|markdown|txt|wiki|html|tex|adoc|xml)$"


def j18_all_mentions(s, d):
    """Names of functions and classes in all document files and in the corpus."""
    n = entities(s, d).where("entity_type in ('Function', 'Class')").select("name")
    f = _files(s, d).where(F.col("content").isNotNull() & F.lower("source_file").rlike(DOCUMENT_FILE)).select(F.lit("source_files").alias("tab"), F.col("source_file").alias("id"), "content")
    t = table(s, d, "documents").where("text is not null").select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    both = f.unionByName(t).select(F.struct("tab", "id").alias("key"), "content")
    return legacy.mentions(both, n, "key").select("key.tab", "key.id", "name")


def j19_requirement_mentions(s, d):
    e = entities(s, d)
    r = e.where("entity_type = 'Requirement'").select("uid", F.coalesce("description", "name").alias("description")).distinct()
    return legacy.requirement_mentions(r, e.where("entity_type = 'Function'").select(F.explode(F.split("name", "_")).alias("name")).where("length(name) > 3"))


def j20_old_endpoints(s, d):
    r = relations(s, d).where("predicate in ('CALLS', 'DEPENDS_ON', 'SELECTS')")
    named = r.select(text.last_field(F.col("subject")).alias("subject"), "predicate", text.last_field(F.col("object")).alias("object"), "source_file", "confidence")
    e = entities(s, d).where("entity_type in ('Function', 'KconfigOption')").select("uid", "name", "source_file").distinct()
    return legacy.resolve_endpoints(named, e)[0].withColumnsRenamed({"subject_uid": "s", "object_uid": "o"})


def u12_generic_imports(s, d):
    return legacy.generic_imports(_files(s, d).where("content is not null and source_file like '%.h'")).select("source_file", "target")


def u12_generic_symbols(s, d):
    f = _files(s, d).where("content is not null and source_file like '%.h'")
    return legacy.generic_symbols(f).where("entity_type in ('Class', 'Type')").select("source_file", "entity_type", "name")


def u14_urls(s, d):
    return legacy.urls(table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_file"), "text"), "text")


def o01_total_order(s, d):
    """Position of every option in the export order (type, file, name)."""
    e = entities(s, d).where("entity_type = 'KconfigOption'").select("uid", "entity_type", "source_file", "name", "entity_id").dropDuplicates(["entity_id"])
    w = Window.partitionBy("source_file").orderBy("name", "entity_id")  # one file's options
    return e.select("entity_id", F.row_number().over(w).cast("int").alias("place"))


def f_scalars(s, d):
    """Scalar functions side by side."""
    f = _files(s, d)
    p = F.col("source_file")
    return f.select("source_file", paths.suffix(p).alias("suffix"), paths.name(p).alias("name"), paths.parent(p).alias("parent"), F.upper("repo").alias("upper"), F.substring("source_file", 3, 5).alias("part"), F.greatest(F.lit(1), "line_count").alias("lines"), text.first_filled(F.col("language"), F.lit("unknown")).alias("lang"))


def f_json(s, d):
    e = entities(s, d).dropDuplicates(["entity_id"])
    return e.select("entity_id", F.get_json_object("metadata", "$.language").alias("language"), F.size(F.coalesce("parameters", F.array().cast("array<string>"))).alias("n"))


def f_normpath(s, d):
    f = _files(s, d).select("source_file", paths.normal(F.concat(paths.parent(F.col("source_file")), F.lit("/../x/./y.h"))).alias("folded"))
    return f


def v01_dense(s, d):
    v = table(s, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()
    return retrieval.dense_search(v, list(q.embedding) if q else [0.0], 10)


def v01_dense_all(s, d):
    """Ten neighbours of every vector whose id is divisible by 20, among all vectors."""
    v = table(s, d, "embeddings")
    return retrieval.dense_search_all(v, v.where("vec_id % 20 = 0"), 10)


def v02_bm25(s, d):
    return retrieval.bm25(table(s, d, "documents").where("text is not null"), "doc_id", "text", "stack trace debugger scheduler", 10)


def v03_fused(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return retrieval.fuse([retrieval.bm25(docs, "doc_id", "text", "stack trace debugger", 20), retrieval.bm25(docs, "doc_id", "text", "unit test scheduler", 20)], "doc_id", 10)


def v05_metadata_filter(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "subject_labels").where("lower(trim(subject)) = 'law'").select("doc_id").distinct()
    return docs.where("lang = 'en'").join(labels, "doc_id").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


def v06_answers(s, d):
    c = table(s, d, "source_chunks").dropDuplicates(["uid"])
    hits = retrieval.bm25(c.where("content is not null"), "uid", "content", "interrupt handler queue", 10)
    return retrieval.answers(hits, c).select("uid", "source_file", "line_start", F.length("excerpt").alias("chars"))


QUERIES = {f.__name__: f for f in (
    s01_folders, s01_contains, s02_file_entities, s05_language, s06_bucket, s07_sha256, s08_line_count, s11_prefix, s12_whitelist, k01_chunks, k04_line_to_chunk, u01_python, u02_c, u03_kconfig, u04_fragment_sets, u05_devicetree, u06_bindings, u07_rst,
    u08_headings, u08_code_spans, u09_dispatch, u10_requirements, u12_generic_imports, u12_generic_symbols, u14_urls, full_build, j01_includes, j02_file_references, j03_symbols, j04_pick_unique, j07_compatibles, j09_document_roles, j09_all_roles, j10_satisfies,
    j13_manifest_diff, a21_changed_counts, j14_untouched, j15_merge_unchanged, j16_stale_folders, j17_delete_nodes, so_sets, j18_mentions, j18_all_mentions, j19_requirement_mentions, j20_old_endpoints, o01_total_order, f_scalars, f_json, f_normpath,
    v01_dense, v01_dense_all, v02_bm25, v03_fused, v05_metadata_filter, v06_answers,
)}

_F = "WITH f AS (SELECT DISTINCT ON (source_file) * FROM source_files)"
_NAME = "regexp_extract(source_file, '[^/]*$')"
_SUFFIX = f"regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1)"
_PARENT = "CASE WHEN contains(source_file, '/') THEN regexp_replace(source_file, '/[^/]*$', '') ELSE '.' END"
_LANG = f"""CASE WHEN lower({_SUFFIX}) = '.py' THEN 'python' WHEN lower({_SUFFIX}) IN ('.c', '.h') THEN 'c' WHEN lower({_SUFFIX}) IN ('.cc', '.cpp', '.cxx', '.hh', '.hpp', '.ipp') THEN 'cpp'
 WHEN {_NAME} = 'Kconfig' OR starts_with({_NAME}, 'Kconfig.') THEN 'kconfig-decl' WHEN lower({_SUFFIX}) IN ('.conf', '.defconfig') OR ends_with({_NAME}, '_defconfig') THEN 'kconfig-fragment'
 WHEN lower({_SUFFIX}) IN ('.dts', '.dtsi', '.overlay') THEN 'devicetree' WHEN lower({_SUFFIX}) IN ('.yaml', '.yml') AND contains('/' || source_file, '/dts/bindings/') THEN 'dt-binding-yaml'
 WHEN lower({_SUFFIX}) = '.rst' THEN 'rst' WHEN lower({_SUFFIX}) IN ('.md', '.markdown') THEN 'markdown' ELSE 'other' END"""
_LINES = "CAST(CASE WHEN content IS NULL OR content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS INTEGER)"
_FOLDERS = "FOLD AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS source_file FROM (SELECT string_split(source_file, '/') AS p, unnest(range(1, len(string_split(source_file, '/')))) AS i FROM {t}) UNION SELECT '.')"
_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_LINE = f"[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*(?:{_END})|[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]+"
_CHUNKS = f"""lines AS (SELECT source_file, regexp_extract_all(content, '{_LINE}') AS l FROM f WHERE content IS NOT NULL),
win AS (SELECT source_file, l, unnest(range(0, greatest(len(l), 1), 200)) AS i FROM lines),
made AS (SELECT DISTINCT source_file, CAST(i + 1 AS INTEGER) AS line_start, CAST(greatest(least(i + 200, len(l)), 1) AS INTEGER) AS line_end, array_to_string(l[i + 1:i + 200], '') AS content FROM win),
chunks AS (SELECT 'SourceChunk|' || source_file || '|' || line_start || '-' || line_end || '|' || substr(sha256(content), 1, 16) AS uid, * FROM made)"""
_SNAP = f"""{_F}, base AS (SELECT file_id, source_file, coalesce(sha256_hash, 'none') AS h FROM f),
old AS (SELECT source_file, CASE WHEN file_id % 7 = 0 THEN 'x' || h ELSE h END AS h FROM base WHERE file_id % 11 <> 0),
new AS (SELECT source_file, h FROM base WHERE file_id % 10 <> 0),
diff AS (SELECT coalesce(old.source_file, new.source_file) AS source_file, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h <> new.h THEN 'modified' ELSE 'unchanged' END AS status FROM old FULL JOIN new USING (source_file)),
gone AS (SELECT source_file FROM diff WHERE status <> 'unchanged')"""
_SNAP_G = WITH + ", " + _SNAP.removeprefix("WITH ")
_SYM = """sym AS (SELECT DISTINCT lower(name) AS key, uid, source_file AS file, CASE coalesce(kind, '') WHEN 'definition' THEN 3 WHEN 'struct' THEN 3 WHEN 'union' THEN 3 WHEN 'enum' THEN 3 WHEN 'typedef' THEN 3 WHEN 'node' THEN 3 WHEN 'declared' THEN 3 WHEN 'referenced' THEN 1 WHEN 'stub' THEN 0 ELSE 2 END AS prio, entity_type FROM ents WHERE uid IS NOT NULL)"""
_INC = f"""{_F}, refs AS (SELECT DISTINCT source_file, unnest(regexp_extract_all(content, '(?m)^[ \\t]*#[ \\t]*include[ \\t]*[<"]([^>"\\n]+)[>"]', 1)) AS target FROM f WHERE content IS NOT NULL AND regexp_matches(source_file, '\\.(c|h|dts|dtsi|overlay)$')),
tails AS (SELECT source_file, unnest(list_transform(range(1, len(string_split(source_file, '/')) + 1), lambda i: array_to_string(string_split(source_file, '/')[i:], '/'))) AS tail FROM f),
uniq AS (SELECT tail, any_value(source_file) AS only FROM tails GROUP BY tail HAVING count(*) = 1)"""
_V = ", ".join


def _bm25(source: str, key: str, column: str, terms: list[str], k: int) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH d AS (SELECT {key}, len(l) AS size, l FROM (SELECT {key}, regexp_extract_all(lower({column}), '[a-z0-9_]+') AS l FROM {source} WHERE {column} IS NOT NULL) WHERE len(l) > 0), s AS (SELECT count(*) AS n, avg(size) AS mean FROM d),
tf AS (SELECT {key}, size, t.term, len(list_filter(l, lambda x: x = t.term)) AS tf FROM d, (VALUES {values}) t(term)), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1)
SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY 1 HAVING sum(tf) > 0 ORDER BY 2 DESC, 1 LIMIT {k}"""


SQL = {
    "s01_folders": f"{_F}, {_FOLDERS.format(t='f')} SELECT source_file, {_NAME} AS name, CASE WHEN source_file = '.' THEN NULL ELSE {_PARENT} END AS parent FROM FOLD".replace(f"{_NAME} AS name", f"CASE WHEN source_file = '.' THEN '.' ELSE {_NAME} END AS name"),
    "s01_contains": f"{_F}, {_FOLDERS.format(t='f')} SELECT 'Folder|' || {_PARENT} AS subject, 'Folder|' || source_file AS object FROM FOLD WHERE source_file <> '.' UNION ALL SELECT 'Folder|' || {_PARENT}, 'SourceFile|' || source_file FROM f",
    "s02_file_entities": f"{_F} SELECT 'SourceFile|' || source_file AS uid, {_NAME} AS name, greatest(1, {_LINES}) AS line_end, {_LANG} AS language, {_SUFFIX} AS extension FROM f",
    "s05_language": f"{_F} SELECT source_file, {_LANG} AS language FROM f",
    "s06_bucket": f"""{_F}, l AS (SELECT *, {_LANG} AS lang FROM f) SELECT CASE WHEN content IS NULL THEN 'binary' WHEN lang IN ('python', 'c', 'cpp') THEN 'code' WHEN lang IN ('kconfig-decl', 'kconfig-fragment', 'devicetree', 'dt-binding-yaml') THEN 'config'
WHEN lang IN ('rst', 'markdown') THEN 'doc' WHEN lower({_SUFFIX}) IN ('.yaml', '.yml', '.json', '.toml', '.ini', '.cfg') THEN 'config' ELSE 'other' END AS bucket, count(*) AS files FROM l GROUP BY 1""",
    "s07_sha256": f"{_F} SELECT source_file, sha256(content) AS sha256 FROM f WHERE content IS NOT NULL",
    "s08_line_count": f"{_F} SELECT source_file, {_LINES} AS line_count FROM f",
    "s11_prefix": f"{_F} SELECT source_file, size_bytes FROM f WHERE starts_with(source_file, 'mesh-lab/')",
    "s12_whitelist": f"{_F} SELECT source_file FROM f WHERE lower({_SUFFIX}) IN ({_V(repr(x) for x in (*inventory.OLD_CODE, *inventory.OLD_DOCS, *inventory.OLD_CONFIG))}) OR starts_with(upper({_NAME}), 'KCONFIG') OR upper({_NAME}) = 'CMAKELISTS.TXT'",
    "k01_chunks": f"{_F}, {_CHUNKS} SELECT uid, source_file, line_start, line_end, CAST(length(content) AS INTEGER) AS chars FROM chunks",
    "k04_line_to_chunk": f"{WITH}, f AS (SELECT DISTINCT ON (source_file) * FROM source_files), {_CHUNKS}, e AS (SELECT DISTINCT entity_id, source_file, line_start FROM ents WHERE entity_type = 'Function') SELECT entity_id, c.uid AS source_chunk_uid FROM e LEFT JOIN chunks c ON c.source_file = e.source_file AND e.line_start BETWEEN c.line_start AND (c.line_start + 199)",
    "u04_fragment_sets": f"""{_F}, l AS (SELECT source_file, generate_subscripts(t, 1) AS n, unnest(t) AS line FROM (SELECT source_file, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM f WHERE content IS NOT NULL AND ({_LANG}) = 'kconfig-fragment')),
v AS (SELECT source_file, n, regexp_extract(line, '^\\s*#\\s*CONFIG_([A-Z0-9_]+)\\s+is not set\\s*$', 1) AS off, regexp_extract(line, '^\\s*CONFIG_([A-Z0-9_]+)\\s*=\\s*(.+?)\\s*$', 1) AS name, regexp_extract(line, '^\\s*CONFIG_([A-Z0-9_]+)\\s*=\\s*(.+?)\\s*$', 2) AS value FROM l)
SELECT source_file, CASE WHEN off <> '' THEN off ELSE name END AS option, arg_max(CASE WHEN off <> '' THEN 'n' ELSE value END, n) AS value FROM v WHERE off <> '' OR name <> '' GROUP BY 1, 2""",
    "u08_headings": f"""{_F}, l AS (SELECT source_file, generate_subscripts(t, 1) AS n, unnest(t) AS line FROM (SELECT source_file, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS t FROM f WHERE content IS NOT NULL AND regexp_matches(lower(source_file), '\\.(md|markdown)$')))
SELECT source_file, CAST(n AS INTEGER) AS line, CAST(length(regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', 1)) AS INTEGER) AS level, regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', 2) AS title FROM l WHERE regexp_matches(line, '^(#{{1,6}})[ \\t]+(.+?)[ \\t]*$')""",
    "u08_code_spans": f"{_F} SELECT DISTINCT source_file, unnest(regexp_extract_all(content, '`([^`\\n]+)`', 1)) AS span FROM f WHERE content IS NOT NULL AND regexp_matches(lower(source_file), '\\.(md|markdown)$')",
    "u10_requirements": f"{_F}, r AS (SELECT source_file, trim(unnest(regexp_extract_all(content, '(?i)[^.!?\\n]*\\b(?:shall|must|should|required to)\\b[^.!?\\n]*[.!?]'))) AS t FROM f WHERE content IS NOT NULL AND regexp_matches(lower(source_file), '\\.(md|rst)$')) SELECT DISTINCT source_file, substr(t, 1, 180) AS name FROM r WHERE length(t) >= 12",
    "u12_generic_imports": f"{_F} SELECT DISTINCT source_file, unnest(regexp_extract_all(content, '(?m)^\\s*#?\\s*(?:include|import)\\s*[<\"]([^>\"]+)', 1)) AS target FROM f WHERE content IS NOT NULL AND source_file LIKE '%.h'",
    "u12_generic_symbols": f"""{_F} SELECT DISTINCT * FROM (SELECT source_file, 'Class' AS entity_type, unnest(regexp_extract_all(content, '\\b(?:class|struct|interface)\\s+([A-Za-z_]\\w*)', 1)) AS name FROM f WHERE content IS NOT NULL AND source_file LIKE '%.h'
UNION ALL SELECT source_file, 'Type', unnest(regexp_extract_all(content, '\\b(?:typedef|enum|union)\\s+(?:class\\s+)?([A-Za-z_]\\w*)', 1)) FROM f WHERE content IS NOT NULL AND source_file LIKE '%.h')""",
    "u14_urls": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source_file, unnest(regexp_extract_all(text, '(?:https?|ftp)://[^\\s<>()\"'']+')) AS url FROM documents WHERE text IS NOT NULL",
    "j02_file_references": f"{_INC} SELECT r.target, coalesce(e.source_file, u.only) AS resolved FROM (SELECT DISTINCT target FROM refs) r LEFT JOIN f e ON e.source_file = r.target LEFT JOIN uniq u ON u.tail = r.target",
    "j01_includes": f"""{_INC} SELECT r.source_file, r.target, coalesce(a.source_file, e.source_file, u.only) AS resolved FROM refs r LEFT JOIN f a ON a.source_file = regexp_replace(r.source_file, '[^/]*$', '') || r.target LEFT JOIN f e ON e.source_file = r.target LEFT JOIN uniq u ON u.tail = r.target""",
    "j03_symbols": f"{WITH}, {_SYM}, t AS (SELECT CASE WHEN entity_type = 'Function' THEN 'function' ELSE 'typelike' END AS target_kind, key, uid, file, prio FROM sym WHERE entity_type IN ('Function', 'Class', 'Type', 'Macro')), u AS (SELECT DISTINCT * FROM t) SELECT target_kind, key, count(*) AS candidates FROM (SELECT * FROM u UNION ALL SELECT 'symbol', key, uid, file, prio FROM u) GROUP BY 1, 2",
    "j04_pick_unique": f"""{WITH}, {_SYM}, fn AS (SELECT DISTINCT key, uid, file, prio FROM sym WHERE entity_type = 'Function'),
p AS (SELECT relation_id, lower(split_part(object, '|', -1)) AS key, split_part(subject, '|', 2) AS file FROM rels WHERE predicate = 'CALLS' AND object LIKE 'Function|%'),
per AS (SELECT key, prio, count(*) AS n, max(uid) AS uid FROM fn GROUP BY 1, 2), al AS (SELECT key, sum(n) AS n, max(struct_pack(prio := prio, ties := n, uid := uid)) AS top FROM per GROUP BY 1),
perf AS (SELECT key, file, prio, count(*) AS n, max(uid) AS uid FROM fn GROUP BY 1, 2, 3), hf AS (SELECT key, file, sum(n) AS n, max(struct_pack(prio := prio, ties := n, uid := uid)) AS top FROM perf GROUP BY 1, 2),
j AS (SELECT p.relation_id, coalesce(al.n, 0) AS n, coalesce(hf.n, 0) AS m, al.top AS ta, hf.top AS tf FROM p LEFT JOIN al USING (key) LEFT JOIN hf USING (key, file)),
c AS (SELECT relation_id, n, CASE WHEN n = 1 THEN ta.uid WHEN m = 1 THEN tf.uid WHEN m > 0 THEN CASE WHEN tf.ties = 1 THEN tf.uid END WHEN ta.ties = 1 THEN ta.uid END AS uid FROM j)
SELECT relation_id, CAST(n AS BIGINT) AS candidate_count, CASE WHEN n = 0 THEN 'none' WHEN uid IS NOT NULL THEN 'ok' ELSE 'ambiguous' END AS status, uid AS target_uid FROM c""",
    "j07_compatibles": f"""{WITH}, b AS (SELECT DISTINCT name, 'DTBinding|' || name AS uid FROM ents WHERE entity_type = 'DTBinding'), r AS (SELECT subject, split_part(object, '|', -1) AS name FROM rels WHERE predicate = 'COMPATIBLE_WITH')
SELECT DISTINCT CASE WHEN b.uid IS NULL THEN NULL ELSE r.subject END AS subject, coalesce(b.uid, r.name) AS object, b.uid IS NOT NULL AS found FROM r LEFT JOIN b USING (name)""",
    "j10_satisfies": f"""{WITH}, w AS (SELECT DISTINCT uid, source_file, line_start - 2 AS a, line_end + 2 AS z FROM ents WHERE entity_type = 'Requirement'), r AS (SELECT DISTINCT source_file, line, object FROM rels WHERE predicate = 'REFERENCES')
SELECT DISTINCT w.uid AS subject, r.object, r.line, CAST(0.9 AS DOUBLE) AS confidence FROM w JOIN r ON w.source_file = r.source_file AND r.line BETWEEN w.a AND w.z""",
    "j13_manifest_diff": f"{_SNAP} SELECT source_file, status FROM diff",
    "a21_changed_counts": f"{_SNAP} SELECT status, count(*) AS files FROM diff GROUP BY 1",
    "j14_untouched": f"{_SNAP_G} SELECT relation_id FROM rels r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_file = r.source_file) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_file = nullif(split_part(r.subject, '|', 2), '')) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.source_file = nullif(split_part(r.object, '|', 2), ''))",
    "j15_merge_unchanged": f"""{_SNAP_G}, e AS (SELECT DISTINCT uid, entity_type, source_file FROM ents WHERE uid IS NOT NULL), n AS (SELECT * FROM e WHERE source_file IN (SELECT source_file FROM gone))
SELECT * FROM n UNION ALL SELECT * FROM e WHERE source_file NOT IN (SELECT source_file FROM gone) AND entity_type NOT IN ('Folder', 'SourceFile') AND uid NOT IN (SELECT uid FROM n)""",
    "j16_stale_folders": f"{_SNAP}, {_FOLDERS.format(t='old').replace('FOLD', 'fa')}, {_FOLDERS.format(t='new').replace('FOLD', 'fb')} SELECT source_file FROM fa EXCEPT SELECT source_file FROM fb",
    "j17_delete_nodes": f"{_SNAP_G}, n AS (SELECT * FROM nodes WHERE file IS NULL OR file NOT IN (SELECT source_file FROM gone)) SELECT 'nodes' AS what, count(*) AS \"left\" FROM n UNION ALL SELECT 'edges', count(*) FROM edges WHERE s IN (SELECT uid FROM n) AND o IN (SELECT uid FROM n)",
    "so_sets": f"{_SNAP} SELECT 'union' AS op, count(*) AS n FROM (SELECT source_file FROM old UNION SELECT source_file FROM new) UNION ALL SELECT 'difference', count(*) FROM (SELECT source_file FROM old EXCEPT SELECT source_file FROM new) UNION ALL SELECT 'intersection', count(*) FROM (SELECT source_file FROM old INTERSECT SELECT source_file FROM new)",
    "j18_mentions": f"{WITH}, f AS (SELECT DISTINCT ON (source_file) * FROM source_files), w AS (SELECT DISTINCT source_file, lower(unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM f WHERE content IS NOT NULL AND source_file LIKE '%.rst') SELECT source_file, name FROM w WHERE name IN (SELECT lower(name) FROM ents WHERE entity_type IN ('Function', 'Class') AND uid IS NOT NULL)",
    "j18_all_mentions": f"""{WITH}, f AS (SELECT DISTINCT ON (source_file) * FROM source_files), t AS (SELECT 'source_files' AS tab, source_file AS id, content FROM f WHERE content IS NOT NULL AND regexp_matches(lower(source_file), '\\.(rst|md|markdown|txt|wiki|html|tex|adoc|xml)$')
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT tab, id, lower(unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM t)
SELECT tab, id, name FROM w WHERE name IN (SELECT lower(name) FROM ents WHERE entity_type IN ('Function', 'Class') AND uid IS NOT NULL)""",
    "j19_requirement_mentions": f"""{WITH}, q AS (SELECT DISTINCT lower(x) AS name FROM (SELECT unnest(string_split(name, '_')) AS x FROM ents WHERE entity_type = 'Function' AND uid IS NOT NULL) WHERE length(x) > 3),
w AS (SELECT DISTINCT uid, lower(unnest(regexp_extract_all(coalesce(description, name), '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM ents WHERE entity_type = 'Requirement' AND uid IS NOT NULL)
SELECT uid AS requirement, name, CAST(0.7 AS DOUBLE) AS confidence FROM w WHERE name IN (SELECT name FROM q)""",
    "j20_old_endpoints": f"""{WITH}, e AS (SELECT DISTINCT uid, lower(name) AS key, source_file FROM ents WHERE entity_type IN ('Function', 'KconfigOption')), al AS (SELECT key, count(DISTINCT uid) AS n, max(uid) AS uid FROM e GROUP BY 1), hf AS (SELECT key, source_file, count(DISTINCT uid) AS n, max(uid) AS uid FROM e GROUP BY 1, 2),
r AS (SELECT lower(split_part(subject, '|', -1)) AS a, predicate, lower(split_part(object, '|', -1)) AS b, source_file, confidence FROM rels WHERE predicate IN ('CALLS', 'DEPENDS_ON', 'SELECTS')),
j AS (SELECT r.predicate, r.confidence, CASE WHEN coalesce(ha.n, aa.n, 0) = 1 THEN coalesce(ha.uid, aa.uid) END AS s, CASE WHEN coalesce(hb.n, ab.n, 0) = 1 THEN coalesce(hb.uid, ab.uid) END AS o FROM r
 LEFT JOIN al aa ON aa.key = r.a LEFT JOIN hf ha ON ha.key = r.a AND ha.source_file = r.source_file LEFT JOIN al ab ON ab.key = r.b LEFT JOIN hf hb ON hb.key = r.b AND hb.source_file = r.source_file)
SELECT s, predicate, o, max(confidence) AS confidence FROM j WHERE s IS NOT NULL AND o IS NOT NULL AND (s <> o OR predicate = 'CALLS') GROUP BY 1, 2, 3""",
    "o01_total_order": f"{WITH} SELECT entity_id, CAST(row_number() OVER (PARTITION BY source_file ORDER BY name, entity_id) AS INTEGER) AS place FROM (SELECT DISTINCT ON (entity_id) * FROM ents WHERE entity_type = 'KconfigOption' AND uid IS NOT NULL)",
    "f_scalars": f"{_F} SELECT source_file, {_SUFFIX} AS suffix, {_NAME} AS name, {_PARENT} AS parent, upper(repo) AS upper, substr(source_file, 3, 5) AS part, greatest(1, line_count) AS lines, coalesce(nullif(language, ''), 'unknown') AS lang FROM f",
    "f_json": f"{WITH} SELECT entity_id, json_extract_string(metadata, '$.language') AS language, CAST(coalesce(len(parameters), 0) AS INTEGER) AS n FROM (SELECT DISTINCT ON (entity_id) * FROM ents WHERE uid IS NOT NULL)",
    "f_normpath": f"{_F} SELECT source_file, CASE WHEN contains({_PARENT}, '/') THEN regexp_replace({_PARENT}, '/[^/]*$', '') || '/x/y.h' ELSE 'x/y.h' END AS folded FROM f",
    "v01_dense": """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform((SELECT e FROM q), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS score FROM p ORDER BY score DESC, vec_id LIMIT 10""",
    "v01_dense_all": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.a, q.a) / sqrt(list_dot_product(v.a, v.a) * list_dot_product(q.a, q.a)), 6) AS score FROM v, v q WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 10""",
    "v02_bm25": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS l FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, len(l) AS size, l FROM w WHERE len(l) > 0), s AS (SELECT count(*) AS n, avg(size) AS mean FROM d),
tf AS (SELECT doc_id, size, t.term, len(list_filter(l, lambda x: x = t.term)) AS tf FROM d, (VALUES ('debugger'), ('scheduler'), ('stack'), ('trace')) t(term)), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY 1 HAVING sum(tf) > 0 ORDER BY 2 DESC, 1 LIMIT 10""",
    "v03_fused": f"""WITH a AS ({_bm25('documents', 'doc_id', 'text', ['debugger', 'stack', 'trace'], 20)}), b AS ({_bm25('documents', 'doc_id', 'text', ['scheduler', 'test', 'unit'], 20)}),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM a UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM b)
SELECT doc_id, round(sum(1.0 / (60 + k)), 8) AS score FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "v06_answers": f"""WITH c AS (SELECT DISTINCT ON (uid) * FROM source_chunks), h AS ({_bm25('c', 'uid', 'content', ['handler', 'interrupt', 'queue'], 10)})
SELECT c.uid, source_file, line_start, CAST(length(substr(content, 1, 200)) AS INTEGER) AS chars FROM h JOIN c USING (uid)""",
    "j09_document_roles": f"""{WITH}, {_SYM}, f AS (SELECT DISTINCT ON (source_file) * FROM source_files), k AS (SELECT DISTINCT CASE WHEN entity_type = 'Function' THEN 'function' ELSE 'typelike' END AS target_kind, key, uid, file, prio FROM sym WHERE entity_type IN ('Function', 'Class', 'Type', 'Macro')),
x AS (SELECT DISTINCT source_file, unnest(regexp_extract_all(content, ':[A-Za-z][A-Za-z0-9_:+-]*:`[^`\\n]+`')) AS ref FROM f WHERE content IS NOT NULL AND source_file LIKE '%.rst'),
y AS (SELECT source_file, regexp_extract(ref, '^:(.+):`([^`]+)`$', 1) AS role, regexp_extract(ref, '^:(.+):`([^`]+)`$', 2) AS target FROM x),
p AS (SELECT *, lower(regexp_replace(target, '\\(\\)$', '')) AS key, CASE WHEN role IN ('c:func', 'cpp:func', 'c:function') THEN 'function' WHEN role IN ('c:struct', 'c:type', 'c:macro', 'c:enum', 'c:union', 'c:enumerator', 'cpp:type', 'cpp:struct') THEN 'typelike' END AS target_kind FROM y),
per AS (SELECT target_kind, key, prio, count(*) AS n, max(uid) AS uid FROM k GROUP BY 1, 2, 3), al AS (SELECT target_kind, key, sum(n) AS n, max(struct_pack(prio := prio, ties := n, uid := uid)) AS top FROM per GROUP BY 1, 2)
SELECT source_file, role, target, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 OR top.ties = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 OR top.ties = 1 THEN top.uid END AS target_uid FROM p LEFT JOIN al USING (target_kind, key) WHERE target_kind IS NOT NULL""",
    "v05_metadata_filter": "SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM subject_labels WHERE lower(trim(subject)) = 'law') GROUP BY 1",
}
