"""C and C++ at file scope, by a scanner of its own: comments, strings and directives are blanked, then braces matched."""

from __future__ import annotations

import re
from bisect import bisect_right

from .records import Emitter

_HIDE = re.compile(r"//(?:[^\\\n]|\\.)*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w+)((?:[^\\\n]|\\\r?\n|\\.)*)", re.M)
_CALL = re.compile(r"(?<![\w.>])([A-Za-z_]\w*)\s*\(")
_FUNCTION = re.compile(r"([A-Za-z_]\w*)\s*\(([^(){}]*(?:\([^()]*\)[^(){}]*)*)\)\s*(?:const|noexcept|override|__\w+(?:\s*\(\(?[^()]*\)?\))?|\s)*$", re.S)
_TYPE_BODY = re.compile(r"\b(struct|union|enum)\s+(?:__\w+(?:\(\([^()]*\)\))?\s+)*([A-Za-z_]\w*)?\s*$")
_NOT_CALLS = frozenset("if for while switch return sizeof do else case defined __attribute__ _Static_assert alignof typeof __typeof__ _Alignof".split())
_VARIABLE = re.compile(r"\*?\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(?:=.*)?$", re.S)


def _blank(m: re.Match) -> str:
    s = m[0]
    if s[0] in "\"'":
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s
    return re.sub(r"[^\n]", " ", s)


def _split(parameters: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(parameters):
        depth += (ch in "([{<") - (ch in ")]}>")
        if ch == "," and depth <= 0:
            out.append(parameters[last:i])
            last = i + 1
    out.append(parameters[last:])
    out = [" ".join(p.split()) for p in out]
    return [p for p in out if p and p != "void"]


def _one_branch(clean: str) -> str:
    """Where the branches of a conditional open or close braces, only its first branch is kept, so that braces match."""
    stack: list[list[int]] = []
    drop: list[tuple[int, int]] = []
    for m in _DIRECTIVE.finditer(clean):
        if m[1] in ("if", "ifdef", "ifndef"):
            stack.append([m.end()])
        elif m[1] in ("else", "elif") and stack:
            stack[-1] += [m.start(), m.end()]
        elif m[1] == "endif" and stack:
            edges = [*stack.pop(), m.start()]
            first = clean[edges[0] : edges[1]]
            if len(edges) > 2 and first.count("{") != first.count("}"):
                drop.append((edges[2], edges[-1]))
    for a, z in drop:
        clean = clean[:a] + re.sub(r"[^\n]", " ", clean[a:z]) + clean[z:]
    return clean


def extract(path: str, text: str, language: str = "c") -> Emitter:
    out = Emitter(path, f"tree-sitter-{language}")  # the name the data model has for this method
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line = lambda offset: bisect_right(starts, offset)
    clean = _HIDE.sub(_blank, text)
    meta = {"language": language}
    for m in _DIRECTIVE.finditer(clean):
        word, rest = m[1], m[2]
        at = line(m.start(1))
        if word == "include" and (t := re.match(r"\s*(?:<([^>\n]+)>|\"([^\"\n]+)\")", text[m.start(2) : m.end()])):
            out.pending("include", out.file_uid, (t[1] or t[2]).strip(), at)
        elif word == "define" and (t := re.match(r"\s*([A-Za-z_]\w*)(\()?", rest)):
            uid = out.entity("Macro", t[1], at, line(m.end()), "function" if t[2] else "object", "", meta, text[m.start() : m.end()].strip())
            out.declare(out.file_uid, uid, at)
    clean = _one_branch(clean)
    clean = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), clean)

    def head(begin: int, end: int, body: tuple[int, int] | None) -> bool:
        """One file-scope item: its head text, and its braces if it has some. True if the item is complete with them."""
        raw = clean[begin:end]
        flat = " ".join(raw.split())
        if not flat:
            return True
        first = line(begin + len(raw) - len(raw.lstrip()))
        last = line(body[1] if body else end)
        source = text[begin + len(raw) - len(raw.lstrip()) : (body[1] + 1) if body else end + 1].strip()
        if body and (t := _TYPE_BODY.search(flat)) and "(" not in flat:
            if t[2]:
                kind = t[1]
                uid = out.entity("Type" if kind == "enum" else "Class", t[2], first, last, kind, "", meta, source)
                out.declare(out.file_uid, uid, first)
            return False
        if flat.startswith("typedef "):
            name = re.search(r"\(\s*\*\s*([A-Za-z_]\w*)", flat) or re.search(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*$", flat)
            if name and not body:
                uid = out.entity("Type", name[1], first, last, "typedef", "", meta | {"underlying": flat[:200]}, source)
                out.declare(out.file_uid, uid, first)
            return not body
        before = flat.split("=")[0]
        if (f := _FUNCTION.search(before if not body else flat)) and f[1] not in _NOT_CALLS and (body or "=" not in flat):
            returns = before[: f.start()].strip() if not body else flat[: f.start()].strip()
            returns = re.sub(r"^(?:(?:static|inline|extern|__\w+|virtual|constexpr)\s+)+", "", returns).strip()
            if returns or body:
                signature = f"{f[1]}({f[2].strip()})"
                uid = out.entity("Function", f[1], first, last, "definition" if body else "declaration", "", meta, source, signature, returns, _split(f[2]))
                out.declare(out.file_uid, uid, first)
                if body:
                    for m in _CALL.finditer(clean, body[0], body[1]):
                        if m[1] not in _NOT_CALLS:
                            out.pending("call", uid, m[1], line(m.start()))
                return True
        if not body and re.match(r"[A-Za-z_]", flat) and " " in before.strip() and "(" not in before:
            for part in _split(flat):
                if (v := _VARIABLE.search(part.split("=")[0].strip())) and v[1] not in ("struct", "union", "enum", "const"):
                    if not re.fullmatch(r"(?:struct|union|enum)\s+\w+", flat):
                        uid = out.entity("Variable", v[1], first, last, "definition", "", meta, source)
                        out.declare(out.file_uid, uid, first)
        return not body

    pos, begin, n = 0, 0, len(clean)
    token, brace = re.compile(r"[{};]"), re.compile(r"[{}]")
    transparent = 0
    while pos < n and (m := token.search(clean, pos)):
        ch, at = m[0], m.start()
        if ch == ";":
            head(begin, at, None)
            begin = pos = at + 1
        elif ch == "}":
            transparent = max(0, transparent - 1)
            begin = pos = at + 1
        else:
            if re.search(r"\bextern\s+\"\s*\"?\s*$", clean[begin:at]) or re.search(r"\bnamespace\b[^;{}]*$", clean[begin:at]):
                transparent += 1
                begin = pos = at + 1
                continue
            depth, end = 1, at + 1
            for b in brace.finditer(clean, at + 1):
                depth += 1 if b[0] == "{" else -1
                if not depth:
                    end = b.start()
                    break
            else:
                end = n - 1
            if "=" in clean[begin:at].split(")")[-1]:  # an initialiser: the head ends at its semicolon
                semi = clean.find(";", end)
                head(begin, at, None)
                begin = pos = (semi if semi >= 0 else n - 1) + 1
                continue
            done = head(begin, at, (at, end))
            if done:
                begin = pos = end + 1
            else:  # a type with a body: names may follow
                semi = clean.find(";", end)
                tail = clean[end + 1 : semi] if semi >= 0 else ""
                if clean[begin:at].lstrip().startswith("typedef") and (t := re.match(r"[\s*]*([A-Za-z_]\w*)", tail)):
                    uid = out.entity("Type", t[1], line(begin + 1), line(semi), "typedef", "", meta | {"underlying": " ".join(text[begin:semi].split())[:200]}, text[begin : semi + 1].strip())
                    out.declare(out.file_uid, uid, line(begin + 1))
                begin = pos = (semi if semi >= 0 else end) + 1
    return out
