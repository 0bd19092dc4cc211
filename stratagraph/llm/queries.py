"""Queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from . import docpairs, leak, mix as mixing, pieces, subjects as topics
from .markup import operator as markup
from .syntax import operator as syntax


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(table(spark, d, "source_files")).where("error_line is not null").select("file_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(syntax.check_files(table(spark, d, "source_files")))


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(table(spark, d, "source_files")).where("error_line is not null")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "source_chunks"), table(spark, d, "chunk_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "entities"), table(spark, d, "source_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("entity_id").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return markup.texts_of(table(spark, d, "source_chunks"), table(spark, d, "entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(_texts(spark, d), render=False).select("tab", "row_id").distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(_texts(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(_leaks(spark, d), table(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return topics.subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return topics.composition(table(spark, d, "documents"), _subjects(spark, d))


QUERIES = {
    "p1_found": p1_found, "p1_rates": p1_rates, "p1_errors": p1_errors,
    "p2_found": p2_found, "p2_pieces": p2_pieces,
    "p3_found": p3_found, "p3_pairs": p3_pairs,
    "p5_found": p5_found, "p5_clean": p5_clean,
    "p6_found": p6_found, "p6_spans": p6_spans, "p6_benchmarks": p6_benchmarks,
    "p7_chosen": p7_chosen, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_composition": p8_composition,
}

_RUNS = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM documents WHERE text IS NOT NULL),
dk AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 11], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 10)) AS i FROM dw)),
iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS l FROM eval_items WHERE item_text IS NOT NULL),
ik AS (SELECT DISTINCT item_id, array_to_string(l[i:i + 11], ' ') AS k FROM (SELECT item_id, l, unnest(range(1, len(l) - 10)) AS i FROM iw)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dk JOIN ik USING (k))
"""
SQL: dict[str, str] = {
    "p2_found": """SELECT DISTINCT chunk_id FROM source_chunks c JOIN chunk_limits l ON coalesce(c.chunk_type, 'fixed_window') = l.chunk_type
WHERE length(content) > max_chars""",
    "p6_found": f"{_RUNS} SELECT doc_id, item_id FROM hits",
    "p6_benchmarks": f"""{_RUNS} SELECT benchmark, count(DISTINCT e.item_id) AS items, count(DISTINCT h.item_id) AS leaked_items, count(DISTINCT h.doc_id) AS documents
FROM eval_items e LEFT JOIN hits h USING (item_id) GROUP BY benchmark""",
}
