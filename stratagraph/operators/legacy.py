"""Operators of the older, pattern-based pipeline that the newer one dropped."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import union_all

# Patterns of the older pipeline.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
URL = "(?:https?|ftp)://[^\\s<>()\"']+"
PATTERNS = {
    "Class": r"\b(?:class|struct|interface)\s+([A-Za-z_]\w*)",
    "Type": r"\b(?:typedef|enum|union)\s+(?:class\s+)?([A-Za-z_]\w*)",
    "Function": r"(?m)^\s*(?:[\w:<>*&]+\s+)+([A-Za-z_]\w*)\s*\([^;\n]*\)\s*(?:\{|$)",
    "function": r"\b(?:function|func)\s+([A-Za-z_]\w*)\s*\(",
}
INCLUDE = r"(?m)^\s*#?\s*(?:include|import)\s*[<\"]([^>\"]+)"
CALL = r"\b([A-Za-z_]\w*)\s*\("
HEADING = r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"
KEYWORDS = ("if", "for", "while", "switch")
REQUIREMENT = r"^\s*(?:(REQ[-_]\w+)\s*[:.-]\s*|(?:the system|it|this)\s+)(?:shall|must|should)?\s*(.+)$"
API = r"\b(?:api|endpoint|interface|function)\s*[:`]*\s*([A-Za-z_]\w*)"
REQUIREMENT_CHARS = 180


def module_entities(files: DataFrame) -> DataFrame:
    """One Module per parsed file."""
    return files.select(F.substring_index("source_file", "/", -1).alias("name"), F.lit("Module").alias("entity_type"), "source_file", F.lit(0.95).alias("confidence"))


def generic_symbols(files: DataFrame) -> DataFrame:
    """(source_file, entity_type, name, confidence) by declaration patterns, for languages without a parser."""
    out = None
    for kind, pattern in PATTERNS.items():
        names = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))))
        rows = files.select("source_file", F.lit(kind.capitalize()).alias("entity_type"), names.alias("name"), F.lit(0.9).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def generic_calls(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of names the same file declares."""
    calls = files.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)))).alias("name")).where(~F.col("name").isin(*KEYWORDS))
    return calls.join(symbols.select("source_file", "name").distinct(), ["source_file", "name"], "left_semi").select("source_file", "name", F.lit(0.75).alias("confidence"))


def generic_imports(files: DataFrame) -> DataFrame:
    return files.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(1)))).alias("target"), F.lit(0.95).alias("confidence"))


def document_concepts(files: DataFrame) -> DataFrame:
    return files.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(HEADING), F.lit(1)))).alias("name"), F.lit(0.85).alias("confidence"))


def urls(files: DataFrame, column: str = "content") -> DataFrame:
    """(source_file, url): addresses that a document names, reported as external resources."""
    return files.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(URL), F.lit(0)))).alias("url"))


def mentions(documents: DataFrame, names: DataFrame, key: str = "source_file", column: str = "content") -> DataFrame:
    """(key, name): identifiers of a text that are names of records, by an equi-join on the token."""
    words = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(IDENTIFIER), F.lit(0)))).alias("word"))
    known = names.select(F.lower("name").alias("name")).distinct()
    return words.select(key, F.lower("word").alias("name")).distinct().join(known, "name").select(key, "name")


def requirement_mentions(requirements: DataFrame, names: DataFrame) -> DataFrame:
    """(requirement, name) with confidence 0.7: records whose name the requirement's text contains as a word."""
    return mentions(requirements, names, "uid", "description").select(F.col("uid").alias("requirement"), "name", F.lit(0.7).alias("confidence"))


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations between names -> (edges between uids, unresolved with candidate counts).

    Each end must have exactly one candidate, those of the relation's own file going first; a relation of a record
    with itself is only kept for CALLS; the surest of several rows per edge stays.
    """
    all_ = entities.groupBy(F.lower("name").alias("key")).agg(F.countDistinct("uid").alias("n"), F.max("uid").alias("uid"))
    here = entities.groupBy(F.lower("name").alias("key"), "source_file").agg(F.countDistinct("uid").alias("n_here"), F.max("uid").alias("uid_here"))
    out = relations
    for end in ("subject", "object"):
        a = all_.select(F.col("key").alias(f"{end}_key"), F.col("n").alias(f"{end}_n"), F.col("uid").alias(f"{end}_any"))
        h = here.select(F.col("key").alias(f"{end}_key"), "source_file", F.col("n_here").alias(f"{end}_h"), F.col("uid_here").alias(f"{end}_own"))
        out = out.withColumn(f"{end}_key", F.lower(end)).join(a, f"{end}_key", "left").join(h, [f"{end}_key", "source_file"], "left")
        out = out.withColumn(f"{end}_count", F.coalesce(f"{end}_h", f"{end}_n", F.lit(0)))
        out = out.withColumn(f"{end}_uid", F.when(F.col(f"{end}_count") == 1, F.coalesce(f"{end}_own", f"{end}_any")))
    ok = F.col("subject_uid").isNotNull() & F.col("object_uid").isNotNull()
    loop = (F.col("subject_uid") == F.col("object_uid")) & (F.col("predicate") != "CALLS")
    good = out.where(ok & ~loop).groupBy("subject_uid", "predicate", "object_uid").agg(F.max("confidence").alias("confidence"))
    reason = F.when(~ok, "not exactly one candidate").otherwise("relation of a record with itself")
    bad = out.where(~ok | loop).select("subject", "predicate", "object", "source_file", "subject_count", "object_count", reason.alias("reason"))
    return good, bad



# ---------------------------------------------------------------- the older pipeline's own extractors

_OLD = "source_file string, rec string, kind string, a string, b string, at int, confidence double"


def _python(path: str, text: str) -> list[tuple]:
    module = path.rpartition("/")[2]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [(path, "ambiguity", "Module", path, "syntax error", getattr(e, "lineno", None) or 1, 0.35)]
    rows = [(path, "entity", "Module", module, None, 1, 0.95)]
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                rows += [(path, "entity", "Function", node.name, None, node.lineno, 0.95), (path, "relation", "CONTAINS", module, node.name, node.lineno, 0.95)]
                named = {x.func.id for x in ast.walk(node) if isinstance(x, ast.Call) and isinstance(x.func, ast.Name)}
                rows += [(path, "relation", "CALLS", node.name, n, node.lineno, 0.85) for n in sorted(named)]
            case ast.ClassDef():
                rows += [(path, "entity", "Class", node.name, None, node.lineno, 0.95), (path, "relation", "CONTAINS", module, node.name, node.lineno, 0.95)]
                rows += [(path, "relation", "EXTENDS", node.name, b.id, node.lineno, 0.95) for b in node.bases if isinstance(b, ast.Name)]
            case ast.Assign() | ast.AnnAssign():
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                rows += [r for t in targets if isinstance(t, ast.Name) for r in ((path, "entity", "Variable", t.id, None, node.lineno, 0.9), (path, "relation", "CONTAINS", module, t.id, node.lineno, 0.9))]
            case ast.Import() | ast.ImportFrom():
                rows += [(path, "relation", "DEPENDS_ON", module, n.name, node.lineno, 0.95) for n in node.names]
    return rows


def python_rows(files: DataFrame) -> DataFrame:
    """Entities, relations and syntax errors of Python files, by name as the older pipeline has them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch.source_file, batch.content) for r in _python(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OLD.split(", ")]).astype({"at": "int32"})

    return files.select("source_file", "content").where("content is not null and source_file like '%.py'").mapInPandas(run, _OLD)


def document_requirements(files: DataFrame) -> DataFrame:
    """(source_file, name, confidence) of lines that state a requirement; the name is cut as the older pipeline cuts it."""
    # line feeds only are line ends (flag d), as in the pattern's own language
    both = [F.regexp_extract_all("content", F.lit("(?imd)" + REQUIREMENT), F.lit(i)) for i in (1, 2)]
    rows = files.select("source_file", F.explode(F.arrays_zip(both[0].alias("mark"), both[1].alias("said"))).alias("r"))
    name = F.trim(F.substring(F.trim(F.concat_ws(" ", F.coalesce("r.mark", F.lit("")), F.regexp_replace("r.said", "\\r$", ""))), 1, REQUIREMENT_CHARS))
    return rows.select("source_file", name.alias("name"), F.lit(0.75).alias("confidence")).distinct()


def document_apis(files: DataFrame) -> DataFrame:
    """(source_file, name, confidence) of names that follow a word for an interface."""
    return files.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("(?i)" + API), F.lit(1)))).alias("name"), F.lit(0.75).alias("confidence"))


def two_levels(files: DataFrame) -> DataFrame:
    """(level, source_file, entity_type, name): structure of code on level 1, concepts, requirements and interfaces of documents on level 2."""
    code = files.where("content is not null and not (source_file like '%.md' or source_file like '%.rst' or source_file like '%.txt')")
    docs = files.where("content is not null and (source_file like '%.md' or source_file like '%.rst' or source_file like '%.txt')")
    py = python_rows(code).where("rec = 'entity'").select(F.lit(1).alias("level"), "source_file", F.col("kind").alias("entity_type"), F.col("a").alias("name"))
    generic = code.where("source_file not like '%.py'")
    out = [py] + [df.select(F.lit(1).alias("level"), "source_file", "entity_type", "name") for df in (module_entities(generic), generic_symbols(generic))]
    named = lambda df, kind: df.select(F.lit(2).alias("level"), "source_file", F.lit(kind).alias("entity_type"), "name")
    out += [named(docs.select("source_file", F.substring_index("source_file", "/", -1).alias("name")), "Document"), named(document_concepts(docs), "Concept"), named(document_requirements(docs), "Requirement"), named(document_apis(docs), "API")]
    return union_all(out).distinct()
