"""Kconfig declarations, configuration fragments, devicetree and binding descriptions."""

from __future__ import annotations

import re

from .records import Emitter, line_of, uid_of

# Names an expression may refer to, and the words of expressions that look like names.
_NAME = re.compile(r"\b[A-Z][A-Z0-9_]{2,}\b")
_OPERATORS = frozenset(["IF", "AND", "OR", "NOT"])
_TYPES = frozenset("bool boolean tristate string int hex def_bool def_tristate def_int def_hex def_string".split())


def kconfig(path: str, text: str) -> Emitter:
    out = Emitter(path, "tree-sitter-kconfig")
    current: dict | None = None
    help_indent = None
    lines = text.split("\n")

    def close(last: int) -> None:
        nonlocal current
        if not current:
            return
        c, current = current, None
        uid = out.entity("KconfigOption", c["name"], c["line"], last, "declared", "\n".join(c["help"]).strip() or c["prompt"], {"type": c["type"], "prompt": c["prompt"]}, "\n".join(lines[c["line"] - 1 : last]).rstrip())
        out.declare(out.file_uid, uid, c["line"])
        for predicate, names, at in c["refs"]:
            for name in names:
                stub = out.entity("KconfigOption", name, at, at, "stub", "", {})
                out.edge(uid, predicate, stub, at, "named in the option")

    for i, raw in enumerate(lines, 1):
        line = raw.rstrip("\r")
        bare = line.strip()
        if help_indent is not None:
            depth = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
            if not bare:
                if current:
                    current["help"].append("")
                continue
            if help_indent == 0:
                help_indent = depth
            if depth >= max(help_indent, 1):
                if current:
                    current["help"].append(bare)
                continue
            help_indent = None
        word, _, rest = bare.partition(" ")
        if "\t" in word:
            word, _, rest = bare.partition("\t")
        rest = rest.strip()
        if word in ("config", "menuconfig") and re.fullmatch(r"[A-Za-z0-9_]+", rest):
            close(i - 1)
            current = {"name": rest, "line": i, "type": "", "prompt": "", "help": [], "refs": []}
        elif word in ("menu", "endmenu", "if", "endif", "choice", "endchoice", "source", "rsource", "osource", "orsource", "comment", "mainmenu"):
            close(i - 1)
        elif current:
            if word in _TYPES:
                current["type"] = word.removeprefix("def_")
                if m := re.match(r'"((?:[^"\\]|\\.)*)"', rest):
                    current["prompt"] = m[1]
            elif word == "prompt":
                current["prompt"] = rest.strip('"')
            elif word in ("help", "---help---"):
                help_indent = 0
            elif word in ("depends", "select"):
                names = [n for n in dict.fromkeys(_NAME.findall(rest if word == "select" else rest.removeprefix("on"))) if n not in _OPERATORS]
                current["refs"].append(("DEPENDS_ON" if word == "depends" else "SELECTS", names, i))
    close(len(lines))
    return out


_FRAGMENT = re.compile(r"^\s*(?:#\s*(CONFIG_[A-Z0-9_]+)\s+is not set|(CONFIG_[A-Z0-9_]+)\s*=\s*(.+?))\s*$")


def fragment(path: str, text: str) -> Emitter:
    out = Emitter(path, "kconfig-fragment-regex")
    for i, line in enumerate(text.splitlines(), 1):
        if m := _FRAGMENT.match(line):
            name = (m[1] or m[2]).removeprefix("CONFIG_")
            stub = out.entity("KconfigOption", name, i, i, "stub", "", {})
            out.edge(out.file_uid, "SETS", stub, i, "assigned here", metadata={"value": "n" if m[1] else m[3].strip()})
    return out


_HIDE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"")
_NODE = re.compile(r"((?:[A-Za-z_]\w*\s*:\s*)*)(&\{[^}]*\}|&?[\w,.+@/-]+|/)\s*$")


def devicetree(path: str, text: str) -> Emitter:
    out = Emitter(path, "tree-sitter-devicetree")
    clean = _HIDE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in re.finditer(r"(?m)^[ \t]*(?:#\s*include|/include/)\s*[<\"]([^>\"]+)[>\"]", clean):
        out.pending("include", out.file_uid, m[1], line_of(text, m.start(1)))
    clean = re.sub(r"(?m)^[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|undef)\b[^\n]*", lambda m: " " * len(m[0]), clean)
    quiet = _STRING.sub(lambda m: '"' + re.sub(r"[^\n]", "_", m[0][1:-1]) + '"', clean)
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(r"[{}]", quiet):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.start()
    stack: list[tuple[str, str]] = []  # uid and node path of the open nodes
    last = 0
    for m in re.finditer(r"[{};]", quiet):
        item = clean[last : m.start()]
        begin, last = last, m.end()
        if m[0] == "}":
            if stack:
                stack.pop()
            continue
        if m[0] == "{":
            if not (h := _NODE.search(item)):
                stack.append(stack[-1] if stack else ("", ""))
                continue
            labels, name = re.findall(r"[A-Za-z_]\w*", h[1]), h[2]
            at = line_of(text, begin + h.start(2))
            end = ends.get(m.start(), len(text) - 1)
            override = name.startswith("&")
            parent, where = stack[-1] if stack else ("", "")
            shown = name[1:].strip("{}") if override else labels[0] if labels else name
            full = f"&{shown}" if override else (where.rstrip("/") + "/" + name.strip("/") if name != "/" else "/")
            uid = out.entity("DTNode", shown, at, line_of(text, end), "node-override" if override else "node", "", {"node_path": full, "labels": labels, "unit_address": name.partition("@")[2]}, text[begin + h.start() : end + 1].strip()[:2000])
            out.declare(out.file_uid, uid, at)
            if parent:
                out.edge(uid, "CHILD_OF", parent, at, "nested node")
            if override:
                out.pending("phandle", uid, shown, at, role="&override")
            else:
                for label in labels:
                    out._add("pending", pend_kind="label", subject=uid, target=label, line=at)
            stack.append((uid, full))
            continue
        if not stack or not stack[-1][0]:
            continue
        p = re.match(r"\s*(?:[A-Za-z_]\w*\s*:\s*)*([\w,.+#?-]+)\s*=\s*(.*)$", item, re.S)
        if not p:
            continue
        at = line_of(text, begin + p.start(1))
        if p[1] == "compatible":
            for value in _STRING.findall(p[2]):
                out.pending("compatible", stack[-1][0], value.strip('"'), at)
        for ref in re.findall(r"&([A-Za-z_]\w*)", _STRING.sub("", p[2])):
            out.pending("phandle", stack[-1][0], ref, at, role=p[1])
    return out


def binding(path: str, text: str) -> Emitter:
    out = Emitter(path, "pyyaml")
    try:
        try:
            import yaml

            data = yaml.safe_load(text)
        except ImportError:  # the one key that matters, without the library
            keys = {m[1]: m[2].strip().strip("\"'") for m in re.finditer(r"(?m)^([\w-]+):[ \t]*(\S.*)?$", text) if m[2]}
            data = keys
    except Exception:
        out.ambiguity(path, "DTBinding", 1, "the binding does not parse")
        return out
    if isinstance(data, dict) and isinstance(data.get("compatible"), str) and data["compatible"]:
        name = data["compatible"]
        uid = out.entity("DTBinding", name, 1, max(1, text.count("\n") + 1), "binding", str(data.get("description") or ""), {"compatible": name})
        out.declare(out.file_uid, uid, 1)
    return out


def option_uid(name: str) -> str:
    return uid_of("KconfigOption", "", name)
