"""Scanners: text of a file -> (terminal names, line numbers), for the parser tables.

A scanner never fails; what no terminal matches becomes the terminal ``bad``, which no grammar has.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

from . import lr

BAD = "bad"

# ---------------------------------------------------------------- JSON

_JSON = re.compile(
    r'(?P<ws>[ \t\r\n]+)|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<LITERAL>(?:true|false|null)\b)|(?P<p>[][{},:])|(?P<bad>.)",
    re.S | re.A,
)


def json(text: str):
    kinds, at = [], []
    for m in _JSON.finditer(text.removeprefix("﻿")):
        k = m.lastgroup
        if k != "ws":
            kinds.append((m[0] if m[0] != ":" else "colon") if k == "p" else k)
            at.append(m.start())
    return kinds, at, text


# ---------------------------------------------------------------- configuration fragments

_SET = re.compile(r'CONFIG_\w+=(?:"(?:[^"\\]|\\.)*"|[^\s"#]+)[ \t]*', re.A)


def fragment(text: str):
    kinds, at, pos = [], [], 0
    for line in text.split("\n"):
        s = line.rstrip("\r")
        b = s.strip()
        kinds.append("BLANK" if not b else "COMMENT" if b[0] == "#" else "SET" if _SET.fullmatch(s) else BAD)
        at.append(pos)
        pos += len(line) + 1
    return kinds, at, text


# ---------------------------------------------------------------- Kconfig

# The keywords of the Kconfig language.
_KCONFIG = {
    "config": "CONFIG", "menuconfig": "MENUCONFIG", "choice": "CHOICE", "endchoice": "ENDCHOICE", "comment": "COMMENT",
    "menu": "MENU", "endmenu": "ENDMENU", "if": "IF", "endif": "ENDIF", "source": "SOURCE", "rsource": "SOURCE",
    "osource": "SOURCE", "orsource": "SOURCE", "mainmenu": "MAINMENU", "bool": "TYPE", "boolean": "TYPE",
    "tristate": "TYPE", "string": "TYPE", "hex": "TYPE", "int": "TYPE", "def_bool": "DEFTYPE", "def_tristate": "DEFTYPE",
    "def_int": "DEFTYPE", "def_hex": "DEFTYPE", "def_string": "DEFTYPE", "prompt": "PROMPT", "default": "DEFAULT",
    "depends": "DEPENDS", "select": "SELECT", "imply": "IMPLY", "range": "RANGE", "visible": "VISIBLE", "optional": "FLAG",
    "modules": "FLAG", "transitional": "FLAG", "option": "OPTION", "help": "HELP", "---help---": "HELP",
}
_KWORD = re.compile(
    r'(?P<ws>[ \t\r\f\v]+)|(?P<c>#.*)|(?P<STRING>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<ASSIGN>[:+]=)'
    r"|(?P<WORD>(?:[\w./-]|\$\((?:[^()]|\([^()]*\))*\))+)|(?P<op>\|\||&&|!=|<=|>=|[=<>!()])|(?P<bad>.)",
    re.A,
)


def kconfig(text: str):
    lines = text.split("\n")
    kinds, at, pos, i = [], [], 0, 0
    starts = []
    for line in lines:
        starts.append(pos)
        pos += len(line) + 1
    while i < len(lines):
        line, begin = lines[i], starts[i]
        i += 1
        while line.rstrip("\r").endswith("\\") and i < len(lines):
            line = line.rstrip("\r")[:-1] + " " + lines[i]
            i += 1
        row: list[str] = []
        assigned = False
        for m in _KWORD.finditer(line):
            k, word = m.lastgroup, m[0]
            if k in ("ws", "c"):
                continue
            if k == "op":
                k = word
                if word == "=" and len(row) == 1 and row[0] == "WORD":
                    k = "ASSIGN"
            elif k == "WORD":
                if not row:
                    k = "MACRO" if word.startswith("$(") and line.strip() == word else _KCONFIG.get(word, "WORD")
                elif word == "if":
                    k = "IF"
                elif word == "on" and row == ["DEPENDS"]:
                    k = "ON"
            row.append(k)
            at.append(begin + m.start())
            if k == "ASSIGN":  # what is assigned is free text
                assigned = True
                break
        if not row:
            continue
        kinds += row
        kinds.append("EOL")
        at.append(begin + len(line))
        if row == ["HELP"] and not assigned:
            indent, had = 0, False
            while i < len(lines):
                body = lines[i].expandtabs(8)
                depth = len(body) - len(body.lstrip())
                if body.strip():
                    if not indent:
                        indent = depth
                    if not depth or depth < indent:
                        break
                    had = True
                i += 1
            if had:
                kinds.append("HELPTEXT")
                at.append(starts[i - 1])
    return kinds, at, text


# ---------------------------------------------------------------- the C preprocessor, for C and devicetree

_COMMENT = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//(?:[^\\\n]|\\.)*|/\*.*?\*/|/\*.*', re.S)
_DIRECTIVE = re.compile(r"^[ \t\f\v]*(?:#|%:)[ \t]*(\w*)((?:[^\\\n]|\\.)*)", re.M | re.S)
# The directives of the C preprocessor.
_DIRECTIVES = frozenset("define undef include include_next import line error warning pragma ident assert embed".split())
_CONDITIONS = frozenset("if ifdef ifndef elif elifdef elifndef else endif".split())
_ATOM = re.compile(r"defined\s*\(\s*(\w+)\s*\)|defined\s+(\w+)|\w+\s*\([^()]*\)|0[xX][\da-fA-F]+[uUlL]*|\d+[uUlL]*|[A-Za-z_]\w*|&&|\|\||[!=]=|[<>]=?|<<|>>|[-+*/%!()?:~&|^]|\S")


def _blank(m: re.Match) -> str:
    s = m[0]
    if s[0] != "/":
        return s
    if s[1] == "*" and (len(s) < 4 or not s.endswith("*/")):
        return "\x00" + "\n" * s.count("\n")
    return re.sub(r"[^\n]", " ", s)


_RELATES = frozenset("== != < > <= >= << >> + - * / % & | ^ ~".split())
_NUMBER = re.compile(r"(0[xX][\da-fA-F]+|0[bB][01]+|\d+)[uUlL]*")


@lru_cache(1 << 14)
def _condition(test: str):
    """An #if expression as a tree of and, or, not over switches: ("is", name), ("rel", text, words) or a constant."""
    words = [m[0] if not (m[1] or m[2]) else "\0" + (m[1] or m[2]) for m in _ATOM.finditer(test)]
    at = 0

    def either(level: int):
        nonlocal at
        op, name = (("||", "or"), ("&&", "and"))[level]
        left = either(1) if level == 0 else operand()
        while at < len(words) and words[at] == op:
            at += 1
            left = (name, left, either(1) if level == 0 else operand())
        return left

    def operand():
        nonlocal at
        begin = at
        tree = single()
        if at < len(words) and words[at] in _RELATES:
            depth = 0
            while at < len(words) and (depth or words[at] not in ("&&", "||", ")")):
                depth += (words[at] == "(") - (words[at] == ")")
                at += 1
            return ("rel", " ".join(words[begin:at]), tuple(words[begin:at]))
        return tree

    def single():
        nonlocal at
        w = words[at]
        at += 1
        if w == "!":
            return ("not", single())
        if w == "(":
            tree = either(0)
            if words[at] != ")":
                raise ValueError(test)
            at += 1
            return tree
        if m := _NUMBER.fullmatch(w):
            return int(m[1], 0 if m[1][:2] in ("0x", "0X", "0b", "0B") else 10) != 0
        if w[0] == "\0" or w[0].isalpha() or w[0] == "_":
            return ("is", re.sub(r"[\s\0]", "", w))
        if w in ("-", "+", "~"):
            single()
            return ("rel", test, ())
        raise ValueError(test)

    try:
        tree = either(0)
        if at < len(words):
            raise ValueError(test)
        return tree
    except (ValueError, IndexError):
        return ("is", test)  # what cannot be read is one switch


def _holds(tree, value):
    """Truth of a condition, or None; value(switch) gives True, False, a number, or None where it is open."""
    if isinstance(tree, bool):
        return tree
    kind = tree[0]
    if kind == "is":
        v = value(tree[1])
        return None if v is None else bool(v)
    if kind == "not":
        v = _holds(tree[1], value)
        return None if v is None else not v
    if kind == "rel":
        v = _number(tree[2], value)
        if v is None:
            v = value(tree[1])
        return None if v is None else bool(v)
    a, b = _holds(tree[1], value), _holds(tree[2], value)
    if kind == "and":
        return False if a is False or b is False else None if a is None or b is None else True
    return True if a or b else None if a is None or b is None else False


def _number(words, value):
    """Value of a relation between numbers and names that stand for numbers, or None."""
    out = []
    for w in words:
        if m := _NUMBER.fullmatch(w):
            out.append(str(int(m[1], 0 if m[1][:2] in ("0x", "0X", "0b", "0B") else 10)))
        elif w[0].isalpha() or w[0] == "_":
            v = value(w)
            if v is None or isinstance(v, bool):
                return None
            out.append(f"({v})")
        elif w in _RELATES or w in "()":
            out.append("//" if w == "/" else w)
        else:
            return None
    try:
        return eval(" ".join(out), {"__builtins__": {}}) if out else None  # numbers and signs only
    except Exception:
        return None


def _switches(tree) -> list[str]:
    if isinstance(tree, bool):
        return []
    return [tree[1]] if tree[0] in ("is", "rel") else [x for t in tree[1:] for x in _switches(t)]


class _Branches:
    """Tree of conditional groups: a list of token runs and groups, a group a list of branches (condition or None for else, body)."""

    def __init__(self):
        self.top: list = []
        self.errors: list[int] = []


def _tree(text: str, scan, hash_names: bool = False):
    """Splits a text without comments at its directives; scan(text, from, to) -> a token run. hash_names: names may start with #."""
    b = _Branches()
    stack: list[tuple[list, list]] = []
    body, last = b.top, 0
    for m in _DIRECTIVE.finditer(text):
        word, rest = m[1], m[2]
        if hash_names and word not in _CONDITIONS and word not in _DIRECTIVES:
            continue
        if m.start() > last:
            body.append(scan(text, last, m.start()))
        last = m.end()
        if word in ("if", "ifdef", "ifndef"):
            group: list = []
            stack.append((body, group))
            body.append(group)
            body = []
            group.append((_test(word, rest), body))
            if not rest.strip():
                b.errors.append(m.start())
        elif word in ("elif", "elifdef", "elifndef", "else"):
            if not stack or stack[-1][1][-1][0] is None:
                b.errors.append(m.start())
                continue
            body = []
            stack[-1][1].append((_test(word, rest), body))
        elif word == "endif":
            if not stack:
                b.errors.append(m.start())
                continue
            body = stack.pop()[0]
        elif word in ("define", "undef") and re.match(r"\s*[A-Za-z_]\w*", rest):
            body.append((word, re.match(r"\s*(\w+)", rest)[1], _value(rest) if word == "define" else False))
        elif word == "include" and re.match(r'\s*(?:<[^>\n]+>|"[^"\n]+"|[A-Za-z_]\w*)', rest):
            pass
        elif (word == "" and not rest.strip()) or word in _DIRECTIVES - {"define", "undef", "include"} or word.isdigit():
            pass
        else:
            body.append(([BAD], [m.start()]))
    if stack:
        b.errors.append(len(text))
    if last < len(text):
        body.append(scan(text, last, len(text)))
    return b


def _test(word: str, rest: str):
    """The condition of a branch; None for else."""
    if word == "else":
        return None
    if word in ("if", "elif"):
        return _condition(rest.strip())
    is_set = ("is", rest.split()[0] if rest.split() else "")
    return ("not", is_set) if "nd" in word else is_set


def _value(rest: str):
    """What a macro stands for in conditions: a number, or True for anything else."""
    m = re.fullmatch(r"\s*\w+[ \t]+\(?\s*" + _NUMBER.pattern + r"\s*\)?\s*", rest)
    return int(m[1], 0 if m[1][:2] in ("0x", "0X", "0b", "0B") else 10) if m else True


# Macros that are not set where C is compiled as C.
_UNSET = {"__cplusplus": False, "__ASSEMBLER__": False, "_ASMLANGUAGE": False}


def _read(items, known: dict, asked: dict[str, bool], default: bool, out: list, met: set[int]) -> None:
    """Follows the branches that hold. known: macros of the file itself; asked: switches set for this reading."""

    def value(name):
        if name in known:
            return known[name]
        return asked.get(name, default)

    for x in items:
        if isinstance(x, tuple):
            if isinstance(x[0], str):
                known[x[1]] = x[2]
            else:
                out.append(x)
            continue
        for test, body in x:
            if test is None or _holds(test, value):
                met.add(id(body))
                _read(body, known, asked, default, out, met)
                break


def _paths(items, above=()):
    """(branch, conditions of it and of all around it) of every branch."""
    for x in items:
        if isinstance(x, list):
            before = above
            for test, body in x:
                own = before if test is None else (*before, (test, True))
                yield body, own
                yield from _paths(body, own)
                if test is not None:
                    before = (*before, (test, False))


def _solve(wanted, default: bool) -> dict[str, bool] | None:
    """Switches under which all conditions are as wanted, or None if there are none; default is tried first."""
    names = list(dict.fromkeys(n for t, _ in wanted for n in _switches(t) if n not in _UNSET))
    chosen: dict[str, bool] = dict(_UNSET)

    def go(i: int) -> bool:
        open_ = False
        for t, want in wanted:
            v = _holds(t, chosen.get)
            if v is None:
                open_ = True
            elif v != want:
                return False
        if not open_:
            return True
        if i == len(names):
            return False
        for v in (default, not default):
            chosen[names[i]] = v
            if go(i + 1):
                return True
        del chosen[names[i]]
        return False

    return chosen if go(0) else None


def readings(text: str, scan, hash_names: bool = False):
    """The token runs a compiler may see, so that every branch that can be read is in one of them.

    Unknown switches (names, and relations between names and numbers) are all off, then all on; for each branch that
    is in neither, switches are sought that make its conditions hold, the others off, or on where that does not do.
    """
    text = text.replace("\r\n", "\n")
    if "/" in text:
        text = _COMMENT.sub(_blank, text)
    if "#" not in text and "%:" not in text:
        yield scan(text, 0, len(text)), text
        return
    b = _tree(text, scan, hash_names)
    if b.errors:
        yield ([BAD], [min(b.errors)]), text
        return
    seen: set = set()
    read: set[int] = set()

    def run(asked: dict[str, bool], default: bool, target=None):
        out: list = []
        met: set[int] = set()
        _read(b.top, dict(_UNSET), asked, default, out, met)
        if target is not None and id(target) not in met:
            return None
        read.update(met)
        key = tuple(map(id, out))
        if key in seen:
            return None
        seen.add(key)
        return ([*chain.from_iterable(x[0] for x in out)], [*chain.from_iterable(x[1] for x in out)]), text

    yield run({}, False)
    if (on := run({}, True)) is not None:
        yield on
    for body, wanted in _paths(b.top):
        for default in (False, True):
            if id(body) not in read and (asked := _solve(wanted, default)) is not None and (got := run(asked, default, body)) is not None:
                yield got


# ---------------------------------------------------------------- C

# Keywords of C17 and GNU C by their role in the grammar.
_C_WORDS = {
    **dict.fromkeys("void char short int long float double signed unsigned _Bool bool _Complex __int128 __builtin_va_list _Float16 _Float32 _Float64 _Float128 __signed__".split(), "BASE"),
    **dict.fromkeys("typedef extern static auto register inline __inline __inline__ _Noreturn _Thread_local __thread thread_local constexpr".split(), "STORAGE"),
    **dict.fromkeys("const volatile restrict __restrict __restrict__ __const __volatile__ __volatile _Atomic".split(), "const"),
    **dict.fromkeys("struct union".split(), "STRUCT"),
    **dict.fromkeys("asm __asm__ __asm".split(), "asm"),
    **dict.fromkeys("typeof __typeof__ __typeof typeof_unqual".split(), "typeof"),
    **dict.fromkeys("_Static_assert static_assert".split(), "_Static_assert"),
    **dict.fromkeys("_Alignas alignas".split(), "_Alignas"),
    **dict.fromkeys("_Alignof alignof __alignof__ __alignof".split(), "_Alignof"),
    **dict.fromkeys("__attribute__ __attribute".split(), "__attribute__"),
    **{w: w for w in "enum if else switch while do for goto continue break return case default sizeof _Generic __extension__".split()},
}
_C = re.compile(
    r"(?P<ws>[ \t\f\v\n\r]+|\\\n)|(?P<STRING>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\")|(?P<CHAR>[uUL]?'(?:[^'\\\n]|\\.)+')"
    r"|(?P<NAME>[^\W\d]\w*|\$\w+)|(?P<NUMBER>\.?\d(?:[eEpP][+-]|[\w.'])*)"
    r"|(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[][(){};,.:?=<>!~+\-*/%&|^])|(?P<bad>.)",
    re.S,
)
_C_NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F']+|0[bB][01']+|\d[\d']*)(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?"
    r"|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFlLiIjJ]?(?:16|32|64|128)?|0[xX](?:[\da-fA-F]+\.?[\da-fA-F]*|\.[\da-fA-F]+)[pP][+-]?\d+[fFlL]?",
    re.A,
)
_C_OPS = {":": "colon", "|": "or"} | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>=".split(), "OP=")
_AFTER_TYPE = frozenset(["BASE", "STORAGE", "const", "STRUCT", "enum", "typeof", "__attribute__"])
_DECLARES = frozenset([";", "=", ",", ")", "[", "(", "colon", "__attribute__", "asm", "{"])


@lru_cache(1 << 16)
def _c_line(line: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    kinds, at = _c_tokens(line, 0, len(line))
    return tuple(kinds), tuple(at)


def _c_run(text: str, a: int, z: int):
    """Tokens of a run. No token of C goes over a line end but behind a backslash, and lines repeat a lot."""
    if "\\\n" in text:
        return _c_tokens(text, a, z)
    kinds, at = [], []
    for line in text[a:z].split("\n"):
        if line:
            k, o = _c_line(line)
            kinds += k
            at += [a + x for x in o]
        a += len(line) + 1
    return kinds, at


def _c_tokens(text: str, a: int, z: int):
    kinds, at = [], []
    add, pos = kinds.append, at.append
    words, ops = _C_WORDS.get, _C_OPS.get
    for m in _C.finditer(text, a, z):
        k = m.lastgroup
        if k == "ws":
            continue
        if k == "NAME":
            k = words(m[0], "NAME")
        elif k == "op":
            k = ops(m[0], m[0])
        elif k == "NUMBER" and not m[0].isdigit() and not _C_NUMBER.fullmatch(m[0]):
            k = BAD
        add(k)
        pos(m.start())
    return kinds, at


def c(text: str):
    return readings(text, _c_run)


def c_types(kinds: list[str]) -> list[str]:
    """The usual reading: which NAME stands for a type. The generalised driver does without."""
    out = list(kinds)
    depth, n = 0, len(kinds)
    for i, k in enumerate(kinds):
        if k == "{":
            depth += 1
        elif k == "}":
            depth -= 1
        elif k == "NAME":
            nxt = kinds[i + 1] if i + 1 < n else ""
            before = out[i - 1] if i else ";"
            if before in ("STRUCT", "enum", "goto", ".", "->"):
                continue
            if nxt == "NAME" and before not in (")", "NAME", "BASE", "TYPE", "]"):
                out[i] = "TYPE"
            elif nxt in ("*", "const") and before in (";", "{", "}", "STORAGE", "const", "(", ",", "colon"):
                j = i + 1
                while j < n and kinds[j] in ("*", "const"):
                    j += 1
                end = kinds[j] if j < n else ""
                if end == ")" and before == "(" or (end == ")" or end == ",") and depth == 0 and before in (",", "(", "const"):
                    out[i] = "TYPE"
                elif end == "NAME" and (kinds[j + 1] if j + 1 < n else "") in _DECLARES and (before not in ("(", ",", "colon") or depth == 0):
                    out[i] = "TYPE"
            elif nxt == ")" and before == "(" and i + 2 < n and kinds[i + 2] in ("NAME", "NUMBER", "STRING", "CHAR", "~", "!", "sizeof", "{"):
                if i < 2 or out[i - 2] not in ("NAME", "if", "while", "for", "switch", ")", "]", "sizeof"):
                    out[i] = "TYPE"
            elif nxt in (")", ",") and before in ("(", ",") and depth == 0:
                pass
            elif nxt in ("BASE", "STORAGE", "const", "STRUCT") and before in (";", "{", "}", "STORAGE"):
                out[i] = "ATTR"
    return out


# ---------------------------------------------------------------- devicetree

_DT = re.compile(
    r"(?P<ws>[ \t\f\v\n\r]+|\\\n)|(?P<STRING>\"(?:[^\"\\]|\\.)*\")|(?P<CHAR>'(?:[^'\\\n]|\\.)+')|(?P<dir>/(?:dts-v1|plugin|memreserve|bits|delete-node|delete-property|omit-if-no-ref|include|incbin)/)"
    r"|(?P<LABEL>[A-Za-z_]\w*:)|(?P<REF>&[A-Za-z_]\w*)|(?P<PATHREF>&\{[^}\s]+\})|(?P<BYTES>\[[\s\da-fA-F]*\])"
    r"|(?P<word>[A-Za-z0-9,._+*#?@-]*[A-Za-z0-9_#][A-Za-z0-9,._+*#?@-]*|,(?=[A-Za-z]))|(?P<op>[{}();=<>,/])|(?P<bad>.)",
    re.A | re.S,
)
_DT_IN = re.compile(
    r"(?P<ws>[ \t\f\v\n\r]+|\\\n)|(?P<STRING>\"(?:[^\"\\]|\\.)*\")|(?P<CHAR>'(?:[^'\\\n]|\\.)+')|(?P<REF>&[A-Za-z_]\w*)|(?P<word>[A-Za-z0-9_]+)"
    r"|(?P<op><<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!?:<>(),;{}=])|(?P<bad>.)",
    re.A | re.S,
)
_DT_NUMBER = re.compile(r"(?:0[xX][\da-fA-F]+|\d+)(?:[uU]?[lL]{0,2}|[lL]{1,2}[uU])", re.A)
_IDENT = re.compile(r"[A-Za-z_]\w*", re.A)


def _dt_run(text: str, a: int, z: int):
    kinds, at, depth, cells = [], [], 0, False
    pos = a
    while pos < z:
        m = (_DT_IN if depth else _DT).match(text, pos, z)
        k, w = m.lastgroup, m[0]
        if k == "word" and not depth and cells and w.endswith(",") and len(w) > 1:  # no list of cells has commas in it
            k = BAD
        pos = m.end()
        if k == "ws":
            continue
        if k == "word":
            k = "NUMBER" if _DT_NUMBER.fullmatch(w) else "NAME" if _IDENT.fullmatch(w) else "PNAME"
            if cells and k == "PNAME":
                k = BAD
        elif k == "op" or k == "dir":
            k = w
            if w == "(":
                depth += 1
            elif w == ")":
                depth = max(0, depth - 1)
            elif not depth and w in "<>":
                cells = w == "<"
        kinds.append(k)
        at.append(m.start())
    return kinds, at


def devicetree(text: str):
    return readings(text, _dt_run, hash_names=True)


# ---------------------------------------------------------------- Python

# The keywords of Python 3.13 (yield and except have own names because the grammar has rules of those names).
_PY_WORDS = {w: w for w in "False None True and as assert async await break class continue def del elif else finally for from global if import in is lambda nonlocal not or pass raise return try while with".split()} | {"yield": "YIELD", "except": "EXCEPT"}
_PY = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n|\r|\n)|(?P<com>#[^\r\n]*)|(?P<cont>\\(?:\r\n|\r|\n))"
    r"|(?P<str>(?i:(?P<prefix>[bu]?r?|rb|f|rf|fr))(?P<quote>\"\"\"|'''|\"|'))"
    r"|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*))"
    r"|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[][(){},:.;@=+\-*/%&|^~<>])|(?P<bad>.)",
    re.S,
)
_PY_OPS = {"|": "vbar"} | dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= <<= >>= **=".split(), "AUG")
_PY_END = {q: re.compile(rf"(?:[^\\{q[0]}]|\\.|{q[0]}(?!{q[0]}{q[0]}))*{q}", re.S) for q in ('"""', "'''")} | {q: re.compile(rf"(?:[^\\{q}\r\n]|\\(?:\r\n|.))*{q}", re.S) for q in "\"'"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_SOFT_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


def _fstring(text: str, pos: int, quote: str, raw: bool) -> int:
    """End of an f-string whose body starts at pos, or -1."""
    n = len(text)
    while pos < n:
        ch = text[pos]
        if text.startswith(quote, pos):
            return pos + len(quote)
        if ch == "\\":
            if not raw and text.startswith("N{", pos + 1):
                end = text.find("}", pos)
                pos = end + 1 if end >= 0 else n
            else:  # a brace is never escaped by it
                pos += 1 if text[pos + 1 : pos + 2] in ("{", "}") else 2
        elif ch in "\r\n" and len(quote) == 1:
            return -1
        elif ch == "{":
            if text.startswith("{{", pos):
                pos += 2
                continue
            pos = _field(text, pos + 1, quote, raw)
            if pos < 0:
                return -1
        elif ch == "}":
            if not text.startswith("}}", pos):
                return -1
            pos += 2
        else:
            pos += 1
    return -1


def _field(text: str, pos: int, quote: str, raw: bool) -> int:
    """End of a replacement field whose expression starts at pos, or -1."""
    begin, depth, n = pos, 0, len(text)
    while pos < n:
        ch = text[pos]
        if ch == "#":
            pos = text.find("\n", pos) if len(quote) == 3 else -1
            if pos < 0:
                return -1
        elif ch in "([{":
            depth += 1
        elif ch in ")]" or (ch == "}" and depth):
            depth -= 1
            if depth < 0:
                return -1
        elif ch in "'\"" or (ch in "fFrRbBuU" and (m := _PY.match(text, pos)).lastgroup == "str"):
            m = _PY.match(text, pos)
            if m.lastgroup != "str":
                return -1
            if "f" in m["prefix"].lower():
                pos = _fstring(text, m.end(), m["quote"], "r" in m["prefix"].lower())
                if pos < 0:
                    return -1
                continue
            e = _PY_END[m["quote"]].match(text, m.end())
            if not e:
                return -1
            pos = e.end()
            continue
        elif not depth and (ch in "}:" or ch == "!" and text[pos + 1 : pos + 2] != "="):
            break
        pos += 1
    else:
        return -1
    inner = text[begin:pos].strip()
    if inner.endswith("=") and inner[-2:-1] not in ("=", "!", "<", ">"):
        inner = inner[:-1]
    if not _valid_field(inner):
        return -1
    if text[pos] == "!":
        if text[pos + 1 : pos + 2] not in ("r", "s", "a"):
            return -1
        pos += 2
        while pos < n and text[pos] in " \t":
            pos += 1
        if text[pos : pos + 1] not in ("}", ":"):
            return -1
    if text[pos] == ":":
        pos += 1
        while pos < n and text[pos] != "}":
            if text[pos] == "{":
                pos = _field(text, pos + 1, quote, raw)
                if pos < 0:
                    return -1
            elif text.startswith(quote, pos) or (len(quote) == 1 and text[pos] in "\r\n"):
                return -1
            else:
                pos += 1
    return pos + 1 if pos < n else -1


@lru_cache(4096)
def _valid_field(inner: str) -> bool:
    t = lr.load("python")
    kinds, _, _ = python(f"({inner}\n)")
    kinds = [k for k in kinds if k != "NEWLINE"]
    return bool(inner) and lr.parse(t, [t.terminals.get(k, -1) for k in kinds] + [t.terminals[lr.END]], "fexpr") == -1


def python(text: str):
    text = text.removeprefix("﻿")
    kinds, at = [], []
    indents = [(0, 0)]
    depth: list[str] = []
    pos, n, fresh = 0, len(text), True
    line_first, opens = 0, []  # soft keywords: where the logical line began; for each open block whether it belongs to a match
    pending_match = False
    if "\x00" in text:
        return [BAD], [text.index("\x00")], text
    match = _PY.match
    add, put = kinds.append, at.append
    while pos < n:
        if fresh and not depth:
            col = alt = 0
            while pos < n and text[pos] in " \t\f":
                ch = text[pos]
                if ch == " ":
                    col, alt = col + 1, alt + 1
                elif ch == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                else:
                    col = alt = 0
                pos += 1
            if pos >= n:
                break
            if text[pos] in "#\r\n" or (text[pos] == "\\" and text[pos + 1 : pos + 2] in "\r\n"):
                if text[pos] == "\\":
                    fresh = False
                    continue
                m = match(text, pos)
                pos = m.end()
                if m.lastgroup == "com" and pos < n:
                    pos = match(text, pos).end()
                continue
            fresh = False
            if col > indents[-1][0]:
                if alt <= indents[-1][1]:
                    add(BAD), put(pos)
                indents.append((col, alt))
                add("INDENT"), put(pos)
                opens.append(pending_match)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    add("DEDENT"), put(pos)
                    opens.pop()
                if (col, alt) != indents[-1]:
                    add(BAD), put(pos)
            pending_match = False
            line_first = len(kinds)
        m = match(text, pos)
        k, start = m.lastgroup, pos
        pos = m.end()
        if k == "quote" or k == "prefix":
            k = "str"
        if k == "ws" or k == "com":
            continue
        if k == "nl":
            if depth:
                continue
            if len(kinds) > line_first:
                first = kinds[line_first]
                if first == "NAME" and (w := text[at[line_first] : at[line_first] + 5]) and kinds[-1] == ":":
                    if w == "match" and len(kinds) - line_first > 2 and _case_follows(text, pos):
                        kinds[line_first] = "MATCH"
                        pending_match = True
                add("NEWLINE"), put(start)
                line_first = len(kinds)
            fresh = True
            continue
        if k == "cont":
            if pos >= n:
                add(BAD), put(start)
            continue
        if k == "str":
            prefix, quote = m["prefix"].lower(), m["quote"]
            if "f" in prefix:
                pos = _fstring(text, pos, quote, "r" in prefix)
            else:
                e = _PY_END[quote].match(text, pos)
                pos = e.end() if e else -1
            if pos < 0:
                add(BAD), put(start)
                return kinds, at, text
            k = "STRING"
        elif k == "name":
            w = m[0]
            k = _PY_WORDS.get(w)
            if k is None:
                k = "NAME"
                if len(kinds) == line_first and not depth:
                    if w == "case" and opens and opens[-1]:
                        k = "CASE"
                    elif w == "type" and re.match(r"[ \t]+[^\W\d]\w*[ \t]*[=\[]", text[pos : pos + 200]):
                        k = "TYPEKW"
                elif kinds and w == "_" and False:
                    pass
            elif k == "in" and kinds and kinds[-1] == "not":
                kinds[-1] = "NOTIN"
                continue
            elif k == "not" and kinds and kinds[-1] == "is":
                kinds[-1] = "ISNOT"
                continue
        elif k == "num":
            k = "NUMBER"
            if pos < n and (text[pos].isalnum() or text[pos] == "_") and not _SOFT_NUMBER.match(text, pos):
                k = BAD
        elif k == "op":
            w = m[0]
            if w in "([{":
                depth.append(w)
            elif w in ")]}":
                if not depth or depth.pop() != _CLOSES[w]:
                    add(BAD), put(start)
                    return kinds, at, text
            k = _PY_OPS.get(w, w)
        add(k), put(start)
    if depth:
        add(BAD), put(n)
    if len(kinds) > line_first:
        add("NEWLINE"), put(n)
    for _ in indents[1:]:
        add("DEDENT"), put(n)
    return kinds, at, text


_NEXT_CASE = re.compile(r"(?:[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\r|\n))*[ \t\f]+case\b")


def _case_follows(text: str, pos: int) -> bool:
    return bool(_NEXT_CASE.match(text, pos))


# ---------------------------------------------------------------- YAML

_Y_SPACE = " \t\r\n\x00"
_Y_PLAIN_END = re.compile(r":(?=[ \t\r\n\x00])|[ \t]#|[\r\n\x00]")
_Y_PLAIN_END_FLOW = re.compile(r":(?=[ \t\r\n\x00,\[\]{}])|[ \t]#|[\r\n\x00,\[\]{}?]")
_Y_DQ = re.compile(r'(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|\r?\n))*"')
_Y_SQ = re.compile(r"(?:[^']|'')*'")
_Y_CTRL = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-퟿-�\U00010000-\U0010ffff]")
_Y_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:(?<=[ \t])#[^\r\n]*)?(?:\r\n|\r|\n|\x00)")
_Y_MARK = re.compile(r"(?:---|\.\.\.)(?=[ \t\r\n\x00])")
_Y_NAME = re.compile(r"[0-9A-Za-z_-]+(?=[ \t\r\n\x00?:,\]}%@`])")
_Y_TAG = re.compile(r"!<[^>\s]+>(?=[ \t\r\n\x00])|!(?:[0-9A-Za-z_-]*!)?[^\s,\[\]{}]*(?=[ \t\r\n\x00,\[\]{}])")


def yaml(text: str):
    text = text.removeprefix("﻿")
    kinds: list[str] = []
    at: list[int] = []
    if m := _Y_CTRL.search(text):
        return [BAD], [m.start()], text
    src = text + "\x00"
    n = len(text)
    pos, line_start, line = 0, 0, 0
    indent, indents, flow = -1, [], 0
    allow = True
    keys: dict[int, tuple[int, int, int, int, bool]] = {}  # by flow level: token index, line, column, position, required

    def fail(where):
        kinds.append(BAD)
        at.append(where)
        return kinds, at, text

    def unwind(col):
        nonlocal indent
        while not flow and indent > col:
            indent = indents.pop()
            kinds.append("END")
            at.append(pos)

    def save_key():
        if allow:
            keys[flow] = (len(kinds), line, pos - line_start, pos, not flow and indent == pos - line_start)
            return True
        old = keys.get(flow)
        if old and not allow:
            pass
        return False

    def advance(upto):
        """Moves on and counts lines."""
        nonlocal pos, line, line_start
        brk = src.count("\n", pos, upto)
        if brk:
            line += brk
            line_start = src.rindex("\n", pos, upto) + 1
        pos = upto

    while True:
        # to the next token
        while True:
            while src[pos] == " " or (src[pos] == "\t" and (flow or not allow)):
                pos += 1
            if src[pos] == "#" and (pos == line_start or src[pos - 1] in " \t\n\r"):
                e = src.find("\n", pos)
                pos = n if e < 0 else e
            if src[pos] == "\r" and src[pos + 1] == "\n":
                pos += 1
            if src[pos] in "\r\n" and pos < n:
                advance(pos + 1)
                if src[pos - 1] == "\r":
                    line, line_start = line + 1, pos
                if not flow:
                    allow = True
                continue
            break
        for lvl, key in list(keys.items()):
            if key[1] != line or pos - key[3] > 1024:
                if key[4]:
                    return fail(key[3])
                del keys[lvl]
        col = pos - line_start
        unwind(col)
        ch, nxt = src[pos], src[pos + 1] if pos < n else "\x00"
        if pos >= n:
            if any(k[4] for k in keys.values()):
                return fail(n)
            if flow:
                return fail(n)
            unwind(-1)
            return kinds, at, text
        if col == 0 and ch == "%":
            unwind(-1)
            keys.clear()
            allow = False
            kinds.append("DIRECTIVE")
            at.append(pos)
            e = src.find("\n", pos)
            pos = n if e < 0 else e
            continue
        if col == 0 and _Y_MARK.match(src, pos):
            if flow:
                return fail(pos)
            unwind(-1)
            keys.clear()
            kinds.append("DOC" if ch == "-" else "DOCEND")
            at.append(pos)
            allow = False
            pos += 3
            continue
        if ch in "[{":
            save_key()
            kinds.append(ch)
            at.append(pos)
            flow += 1
            allow = True
            pos += 1
            continue
        if ch in "]}":
            keys.pop(flow, None)
            flow = max(0, flow - 1)
            allow = False
            kinds.append(ch)
            at.append(pos)
            pos += 1
            continue
        if ch == ",":
            keys.pop(flow, None)
            allow = True
            kinds.append(",")
            at.append(pos)
            pos += 1
            continue
        if ch == "-" and nxt in _Y_SPACE:
            if flow or not allow:
                return fail(pos)
            if indent < col:
                indents.append(indent)
                indent = col
                kinds.append("SEQ")
                at.append(pos)
            allow = True
            keys.pop(flow, None)
            kinds.append("ENTRY")
            at.append(pos)
            pos += 1
            continue
        if ch == "?" and (flow or nxt in _Y_SPACE) and nxt in _Y_SPACE:
            if not flow:
                if not allow:
                    return fail(pos)
                if indent < col:
                    indents.append(indent)
                    indent = col
                    kinds.append("MAP")
                    at.append(pos)
            allow = not flow
            keys.pop(flow, None)
            kinds.append("KEY")
            at.append(pos)
            pos += 1
            continue
        if ch == ":" and (nxt in _Y_SPACE or (flow and (nxt in ",[]{}" or kinds[-1:] in (["SCALAR"], ["]"], ["}"]) and keys.get(flow) and src[pos - 1] in "\"']}"))):
            key = keys.pop(flow, None)
            if key:
                index, _, kcol, kpos, _ = key
                kinds.insert(index, "KEY")
                at.insert(index, kpos)
                if not flow and indent < kcol:
                    indents.append(indent)
                    indent = kcol
                    kinds.insert(index, "MAP")
                    at.insert(index, kpos)
                allow = False
            else:
                if not flow:
                    if not allow:
                        return fail(pos)
                    if indent < col:
                        indents.append(indent)
                        indent = col
                        kinds.append("MAP")
                        at.append(pos)
                allow = not flow
            kinds.append("VALUE")
            at.append(pos)
            pos += 1
            continue
        if ch in "*&":
            m = _Y_NAME.match(src, pos + 1)
            if not m:
                return fail(pos)
            save_key()
            allow = False
            kinds.append("ALIAS" if ch == "*" else "ANCHOR")
            at.append(pos)
            pos = m.end()
            continue
        if ch == "!":
            m = _Y_TAG.match(src, pos)
            if not m:
                return fail(pos)
            save_key()
            allow = False
            kinds.append("TAG")
            at.append(pos)
            pos = m.end()
            continue
        if ch in "|>" and not flow:
            m = _Y_BLOCK.match(src, pos)
            if not m:
                return fail(pos)
            keys.pop(flow, None)
            kinds.append("SCALAR")
            at.append(pos)
            header = m[0]
            given = re.search(r"[1-9]", header.split("#")[0])
            least = max(1, indent + 1)
            depth = max(0, indent) + int(given[0]) if given else 0
            advance(min(m.end(), n))
            while pos < n:
                e = src.find("\n", pos)
                e = n if e < 0 else e
                body = src[pos:e]
                stripped = body.lstrip(" ")
                if stripped.strip("\r"):
                    lead = len(body) - len(stripped)
                    if not depth:
                        depth = max(least, lead)
                    if lead < depth:
                        break
                advance(min(e + 1, n))
            allow = True
            continue
        if ch in "\"'":
            m = (_Y_DQ if ch == '"' else _Y_SQ).match(src, pos + 1, n)
            if not m or re.search(r"\n(?:---|\.\.\.)(?=[ \t\r\n])", m[0]):
                return fail(pos)
            save_key()
            allow = False
            kinds.append("SCALAR")
            at.append(pos)
            advance(m.end())
            continue
        if ch in "#,[]{}&*!|>'\"%@`\t" or (ch in "-?:" and (nxt in _Y_SPACE or (flow and ch in "?:"))):
            return fail(pos)
        # a plain scalar
        save_key()
        allow = False
        kinds.append("SCALAR")
        at.append(pos)
        ends = _Y_PLAIN_END_FLOW if flow else _Y_PLAIN_END
        while True:
            m = ends.search(src, pos)
            stop = m.start()
            if src[stop] not in "\r\n" or stop >= n:
                pos = stop
                break
            # the text may go on in the next lines
            back = (pos, line, line_start)
            advance(stop)
            look = stop
            while src[look] in " \t\r\n" and look < n:
                look += 1
            advance(look)
            allow = True
            deeper = pos - line_start
            if pos >= n or (not flow and deeper < indent + 1) or src[pos] == "#" or (deeper == 0 and _Y_MARK.match(src, pos)):
                break
            if src[pos] == ":" and src[pos + 1] in _Y_SPACE or flow and src[pos] in ",:?[]{}":
                break
            if "\t" in src[line_start:pos] and not flow and False:
                pos, line, line_start = back
                break
