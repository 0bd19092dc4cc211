"""Texts as sequences of leaves: a leaf is a line with text, with the path of what is open around it."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

BUCKETS = 4096
LONG = 48  # characters of a token from which its line is also read in pieces

# Doxygen commands that may follow @ or \ without braces.
DOXYGEN = "param|tparam|returns?|retval|brief|details|note|warning|attention|see|sa|since|todo|deprecated|ingroup|defgroup|addtogroup|file|author|date|version|pre|post|invariant|throws?|exception|ref|link|endlink|code|endcode|verbatim|endverbatim|copydoc|name|struct|fn|def|var|enum|anchor|par|short|remarks?|result|internal|cond|endcond|c|p|a|e|b|f\\$|f\\[|f\\]|n|li|arg|kconfig|rst|endrst"
_DOXY = re.compile(rf"[@\\](?:{DOXYGEN})(?![A-Za-z{{\[])(?:\[[\w,]+\])?")
_HASH_METHODS = ("python-ast", "pyyaml", "tree-sitter-kconfig", "kconfig-fragment-regex")


def without_marks(text: str, method: str | None) -> str:
    """A description without the comment marks of its programming language and without Doxygen tags."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    bare = text.strip()
    lines = text.split("\n")
    filled = [x.lstrip() for x in lines if x.strip()]
    if bare.startswith("/*"):
        text = re.sub(r"\A\s*/\*[*!]*<?", "", text)
        text = re.sub(r"\**\*/\s*\Z", "", text)
        text = re.sub(r"(?m)^[ \t]*\*(?=[ \t]|$)[ \t]?", "", text)
    elif filled and all(x.startswith("//") for x in filled):
        text = re.sub(r"(?m)^[ \t]*//[/!]?<?[ \t]?", "", text)
    elif filled and method in _HASH_METHODS and all(re.match(r"#(?!#)", x) for x in filled):
        text = re.sub(r"(?m)^[ \t]*#[ \t]?", "", text)
    elif bare[:3] in ('"""', "'''"):
        text = bare.strip("\"'")
    return _DOXY.sub(" ", text)


_OPEN = re.compile(
    r"<(/?)(ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|pre|code|p|div|blockquote|span|a|b|i|em|strong|ref|nowiki|math|h[1-6])\b[^<>]*?(/?)>|<!--|-->|\\(begin|end)\{(\w+\*?)\}|(\\\[)|(\\\])|(\{\|)|(\|\})",
    re.I,
)
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})(.*)$")


def leaves(text: str) -> list[tuple[str, tuple[str, ...], bool]]:
    """(line, path before it, whether a blank line or the start of the text is before it). A path has each name once, outermost first."""
    out = []
    path: list[str] = []
    count: dict[str, int] = {}  # how often each name is open, in the order of opening
    around: tuple[str, ...] = ()
    fence = ""
    fresh = True

    def enter(name: str) -> None:
        nonlocal around
        path.append(name)
        count[name] = count.get(name, 0) + 1
        if count[name] == 1:
            around = (*around, name)

    def leave(name: str) -> None:
        """Closes the last element of the name, and what is open inside it."""
        nonlocal around
        if name not in count:
            return
        last = ""
        while last != name:
            last = path.pop()
            count[last] -= 1
            if not count[last]:
                del count[last]
        around = tuple(count)

    for line in text.split("\n"):
        if not line.strip():
            fresh = True
            continue
        out.append((line, around, fresh))
        fresh = False
        m = _FENCE.match(line)
        if m and (not fence or (m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip())):
            if fence:
                leave("fence")
                fence = ""
            elif m[1][0] == "~" or "`" not in m[2]:
                fence = m[1]
                enter("fence")
            continue
        if fence:
            continue
        for m in _OPEN.finditer(line):
            token = m[0]
            if m[2]:
                if not m[3]:
                    (leave if m[1] else enter)(m[2].lower())
            elif token == "<!--":
                enter("comment")
            elif m[4] == "begin":
                enter("env:" + m[5])
            elif m[6]:
                enter("display")
            elif m[8]:
                enter("wikitable")
            else:
                leave("comment" if token == "-->" else "env:" + m[5] if m[4] else "display" if m[7] else "wikitable")
    return out


_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUN = re.compile(r"([=~`*#_\-.+])\1{2,}")


@lru_cache(65536)
def shape(token: str) -> str:
    s = _LETTERS.sub("a", token)
    s = _DIGITS.sub("0", s)
    return _RUN.sub(r"\1\1\1", s)


@lru_cache(65536)
def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@lru_cache(65536)
def _of_token(token: str) -> tuple[int, ...]:
    """Features of a token with signs in it: its shape, and the shape's groups of three."""
    s = shape(token.rstrip(".,;:!?") or token)
    if s in ("a", "0"):
        return ()
    ids = [bucket("S:" + s)]
    ids += [bucket("T:" + s[i : i + 3]) for i in range(len(s) - 2)] if len(s) > 3 else []
    return tuple(ids)


@lru_cache(65536)
def _of_line(line: str, path: tuple[str, ...], fresh: bool) -> tuple[int, ...]:
    tokens = line.split()
    ids = [bucket("P:" + p) for p in path] + [bucket("D:" + str(min(len(path), 4)))]
    first = shape(tokens[0])
    ids += [bucket("F:" + first), bucket("L:" + shape(tokens[-1])), bucket("fresh" if fresh else "inside"), bucket("n:" + str(min(len(tokens), 8)))]
    if line[0] in " \t":
        ids.append(bucket("indent" if line.startswith(("    ", "\t")) else "space"))
    if len(line) <= 60:
        ids.append(bucket("N:" + " ".join(shape(t) for t in tokens)))
    if tokens[0].isalpha() and len(tokens[0]) < 12:
        ids.append(bucket("W:" + tokens[0].lower()))
    for t in tokens:
        if not t.isalnum():
            ids += _of_token(t)
    return tuple(dict.fromkeys(ids))


def features(text: str) -> list[tuple[int, ...]]:
    return [_of_line(line, path, fresh) for line, path, fresh in leaves(text)]


def is_long(line: str) -> bool:
    """Whether signs in it may drown among the features of the rest."""
    return len(line) > 2000 or any(len(t) > LONG and not t.isalnum() for t in line.split())


def pieces(line: str, path: tuple[str, ...], fresh: bool) -> list[tuple[int, ...]]:
    """Features of a line's overlapping pieces: every run of LONG characters stands whole in one of them."""
    parts = [line[i : i + 2 * LONG] for i in range(0, max(1, len(line) - LONG), LONG)]
    return [_of_line(x, path, fresh and not i) for i, x in enumerate(parts) if x.strip()]
