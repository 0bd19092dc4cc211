"""reStructuredText and Markdown documents."""

from __future__ import annotations

import re

from .records import Emitter, line_of, uid_of

# Fixed value: what a requirement sentence looks like.
REQUIREMENT = re.compile(r"[^.!?\n]*\b(?:shall|must|should|required to)\b[^.!?\n]*[.!?]", re.I)
MIN_SENTENCE, MAX_NAME = 12, 180
_ADORN = re.compile(r"([=\-`:.'\"~^_*+#])\1{2,}\s*$")
_ROLE = re.compile(r":([A-Za-z][\w:+-]*):`([^`\n]+)`")
_ANCHOR = re.compile(r"(?m)^\.\.[ \t]+_([^:\n]+):[ \t]*$")


def _requirements(out: Emitter, document: str, text: str, first: int, window: tuple[int, int] | None) -> None:
    for m in REQUIREMENT.finditer(text):
        sentence = " ".join(m[0].split())
        if len(sentence) < MIN_SENTENCE:
            continue
        line = first + text.count("\n", 0, m.start())
        uid = out.entity("Requirement", sentence[:MAX_NAME], line, line, "", sentence, {})
        out.edge(document, "CONTAINS", uid, line, "sentence with a modal verb")
        a, z = window or (line, line)
        out.pending("window", uid, "", line, window=(a, z))


def rst(path: str, text: str) -> Emitter:
    out = Emitter(path, "tree-sitter-rst")
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    sections: list[tuple[int, str, int]] = []  # line, title, depth
    styles: list[str] = []
    i = 0
    while i < len(lines):
        over = _ADORN.match(lines[i]) if lines[i].strip() else None
        if over and i + 2 < len(lines) and lines[i + 1].strip() and (u := _ADORN.match(lines[i + 2])) and u[1] == over[1]:
            style, title, at = "o" + over[1], lines[i + 1].strip(), i + 2
            step = 3
        elif i + 1 < len(lines) and lines[i].strip() and not lines[i][0].isspace() and (u := _ADORN.match(lines[i + 1])) and len(lines[i + 1].rstrip()) >= len(lines[i].rstrip()) and not over:
            style, title, at = u[1], lines[i].strip(), i + 1
            step = 2
        else:
            i += 1
            continue
        if style not in styles:
            styles.append(style)
        sections.append((at, title, styles.index(style)))
        i += step
    name = path.rpartition("/")[2]
    title = sections[0][1] if sections else name
    document = out.entity("Document", name, 1, max(1, len(lines)), "", title, {})
    for at, heading, depth in sections:
        uid = out.entity("Concept", heading, at, at, f"heading-{depth}", "", {})
        out.edge(document, "HAS_SECTION", uid, at, "section title")
    for m in _ANCHOR.finditer(text):
        out.pending("anchor", document, m[1].strip().strip("`"), line_of(text, m.start()))
    titled = {at for at, _, _ in sections} | {at + 1 for at, _, _ in sections}
    start = None
    for n, line in enumerate([*lines, ""], 1):
        plain = line.strip() and n not in titled and not line.lstrip().startswith("..")
        if plain and start is None:
            start = n
        elif not plain and start is not None:
            _requirements(out, document, "\n".join(lines[start - 1 : n - 1]), start, (start, n - 1))
            start = None
    for m in _ROLE.finditer(text):
        out.pending("docref", document, m[2].strip().lstrip("~!"), line_of(text, m.start()), role=m[1])
    return out


_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_SPAN = re.compile(r"`([^`\n]+)`")


def markdown(path: str, text: str) -> Emitter:
    out = Emitter(path, "markdown-heading")
    text = text.replace("\r\n", "\n")
    document = out.entity("Document", path.rpartition("/")[2], 1, max(1, text.count("\n") + 1), "", "", {})
    for m in _HEADING.finditer(text):
        at = line_of(text, m.start())
        uid = out.entity("Concept", m[2].strip(), at, at, f"heading-{len(m[1])}", "", {})
        out.edge(document, "HAS_SECTION", uid, at, "heading")
    for m in _SPAN.finditer(text):
        out.pending("docref", document, m[1].strip(), line_of(text, m.start()), role="code-span")
    _requirements(out, document, text, 1, None)
    return out


def document_uid(path: str) -> str:
    return uid_of("Document", path, path.rpartition("/")[2])
