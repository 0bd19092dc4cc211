"""Rows an extractor emits: one tagged shape for entities, relations, references to resolve, and ambiguities."""

from __future__ import annotations

import json

from ..schema import GLOBAL_TYPES, PATH_TYPES

#: rec is entity, relation, pending or ambiguity; seq orders the rows of a file as they were emitted.
SHAPE = (
    "rec string, seq int, uid string, name string, entity_type string, source_file string, line_start int, line_end int, kind string, "
    "extraction_method string, description string, metadata string, source_text string, signature string, return_type string, parameters array<string>, "
    "subject string, predicate string, object string, confidence double, line int, rationale string, role string, "
    "pend_kind string, target string, win_start int, win_end int, reason string"
)
COLUMNS = [c.split()[0] for c in SHAPE.split(", ")]


def uid_of(entity_type: str, source_file: str, name: str) -> str:
    if entity_type in GLOBAL_TYPES:
        return f"{entity_type}|{name}"
    if entity_type in PATH_TYPES:
        return f"{entity_type}|{source_file}"
    return f"{entity_type}|{source_file}|{name}"


class Emitter:
    """Collects the rows of one file."""

    def __init__(self, path: str, method: str):
        self.path, self.method, self.rows = path, method, []
        self.file_uid = uid_of("SourceFile", path, path)

    def _add(self, rec: str, **values) -> None:
        values |= {"rec": rec, "seq": len(self.rows), "source_file": self.path}
        self.rows.append(tuple(values.get(c) for c in COLUMNS))

    def entity(self, entity_type: str, name: str, start: int, end: int, kind: str = "", description: str = "", metadata: dict | None = None, text: str = "", signature: str = "", returns: str = "", parameters=()) -> str:
        uid = uid_of(entity_type, self.path, name)
        self._add(
            "entity", uid=uid, name=name, entity_type=entity_type, line_start=start, line_end=end, kind=kind, extraction_method=self.method, description=description,
            metadata=json.dumps(metadata or {}), source_text=text, signature=signature, return_type=returns, parameters=list(parameters),
        )
        return uid

    def edge(self, subject: str, predicate: str, obj: str, line: int, rationale: str, confidence: float = 1.0, role: str = "", metadata: dict | None = None) -> None:
        self._add("relation", subject=subject, predicate=predicate, object=obj, confidence=confidence, line=line, rationale=rationale, role=role, metadata=json.dumps(metadata or {}))

    def declare(self, owner: str, uid: str, line: int) -> None:
        self.edge(owner, "DECLARES", uid, line, "declared here")

    def pending(self, kind: str, subject: str, target: str, line: int, role: str = "", window: tuple[int, int] | None = None) -> None:
        self._add("pending", pend_kind=kind, subject=subject, target=target, line=line, role=role, win_start=window and window[0], win_end=window and window[1])

    def ambiguity(self, name: str, entity_type: str, line: int, reason: str) -> None:
        self._add("ambiguity", name=name, entity_type=entity_type, line_start=line, reason=reason)


def line_of(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1
