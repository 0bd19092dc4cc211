"""Record shapes of the graph, and the rules that give a record its identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: which labels are named globally or by path, how strongly a kind claims its uid,
# and which reference roles of documents name what.
GLOBAL_TYPES = ("KconfigOption", "DTBinding")
PATH_TYPES = ("Folder", "SourceFile")
KIND_PRIORITY = {"definition": 3, "struct": 3, "union": 3, "enum": 3, "typedef": 3, "node": 3, "declared": 3, "declaration": 2, "": 2, "referenced": 1, "stub": 0}
OTHER_PRIORITY = 2

ENTITY = (
    "name string, entity_type string, source_file string, line_start int, line_end int, kind string, extraction_method string, "
    "description string, metadata string, source_text string, signature string, return_type string, parameters array<string>"
)
RELATION = "subject string, predicate string, object string, confidence double, source_file string, line int, rationale string, role string, metadata string"
CHUNK = "uid string, source_file string, line_start int, line_end int, content string, chunk_type string"
AMBIGUITY = "entity_name string, entity_type string, source_file string, line_number int, reason string"
UNRESOLVED = "subject string, predicate string, object string, source_file string, line int, reason string, candidate_count long"


def entity_uid(entity_type: str = "entity_type", source_file: str = "source_file", name: str = "name") -> Column:
    """The deterministic uid of a record, by the scope of its type."""
    t, f, n = F.col(entity_type), F.col(source_file), F.col(name)
    return (
        F.when(t.isin(*GLOBAL_TYPES), F.concat(t, F.lit("|"), n))
        .when(t.isin(*PATH_TYPES), F.concat(t, F.lit("|"), f))
        .otherwise(F.concat(t, F.lit("|"), f, F.lit("|"), n))
    )


def kind_priority(kind: Column) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for k, p in KIND_PRIORITY.items():
        out = F.when(F.coalesce(kind, F.lit("")) == k, p).otherwise(out)
    return out
