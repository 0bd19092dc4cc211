"""From labelled leaves to clean text: structure stays visible, markup goes.

Headings stand alone between blank lines, list items start with a bullet, code is indented, the cells of a table row
are parted by `` | ``, and formulas keep their source. ``evidence`` is the exact check of a leaf that the labeller
takes for markup: it names the signs that make it so.
"""

from __future__ import annotations

import html
import re

from .lstm import LABELS

NAMES = {name: i for i, name in enumerate(LABELS)}

# The elements of HTML, and of wiki text, that count as markup.
ELEMENTS = "a|abbr|article|aside|b|big|blockquote|body|br|caption|center|cite|code|col|dd|del|details|div|dl|dt|em|figcaption|figure|font|footer|h[1-6]|head|header|hr|html|i|iframe|img|ins|kbd|li|link|main|mark|math|meta|nav|nowiki|ol|p|pre|q|ref|references|s|samp|script|section|small|source|span|strike|strong|style|sub|summary|sup|syntaxhighlight|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul|var|video|gallery|poem|includeonly|noinclude|onlyinclude"
_TAG = re.compile(rf"</?(?:{ELEMENTS})(?:\s[^<>]*)?/?>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_COMMAND = re.compile(r"\\(?:[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])*\{|(?:item|hline|maketitle|tableofcontents|LaTeX|TeX|newline|noindent|par|centering|clearpage|newpage|bigskip|medskip|smallskip)\b|\\(?=\s*$))")
_MATH = re.compile(r"\$\$.+?\$\$|(?<![\\$\w])\$(?!\s)(?=[^$\n]*(?:[\\^_={}<>+*/]|[A-Za-z]))(?!\d+(?:\.\d+)?\s)[^$\n]+?(?<!\s)\$(?![\w$])|\\\[.*?\\\]|\\\(.+?\\\)|<math>.*?</math>", re.S)
_WIKI = re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|'''?[^'\n]+'''?|\[https?://[^\s\]]+(?: [^\]\n]*)?\](?!\()|^\{\||^\|\}|^\|-+|^! |^__[A-Z]+__\s*$", re.M)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]*)(?:\s+\"[^\"\n]*\")?\)|!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]|<https?://[^<>\s]+>|^\s{0,3}\[[^\]\n]+\]:\s+\S+", re.M)
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_STRONG = re.compile(r"(?<![\w*])\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?![\w*])|(?<![\w_])__(?=[^\W_])([^_\n]*?[^\W_])__(?![\w_])|~~(?=\S)([^~\n]+?)(?<=\S)~~")
_EMPH = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\W_])([^_\n]*?[^\W_])_(?![\w_])")
_HEAD = re.compile(r"^\s{0,3}#{1,6}\s+\S|^(={1,6})\s*[^=\s].*?\1\s*$", re.M)
_RULE = re.compile(r"^\s{0,3}(?:=+|-{2,})\s*$")
_FENCE = re.compile(r"^\s{0,3}(?:`{3,}|~{3,})")
_PIPES = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")
_BULLET = re.compile(r"^\s*(?:[*+-]|\d{1,3}[.)]|[*#:;]{1,4})\s+")
_QUOTE = re.compile(r"^\s{0,3}>\s?")
_CELLS = re.compile(r"\|\||!!|\||(?<!\\)&(?!\w+;)")


def evidence(line: str, before: str, after: str, path: tuple[str, ...]) -> list[str]:
    """Names of the signs of markup in a line; ``before`` and ``after`` are the lines next to it."""
    found = [name for name, p in (("tag", _TAG), ("comment", _COMMENT), ("entity", _ENTITY), ("command", _COMMAND), ("math", _MATH), ("wiki", _WIKI), ("link", _LINK), ("code", _CODE), ("strong", _STRONG), ("emphasis", _EMPH), ("heading", _HEAD), ("fence", _FENCE), ("table", _PIPES), ("quote", _QUOTE)) if p.search(line)]
    if "-->" in line or "<!--" in line:
        found.append("comment")
    if path:
        found.append("inside")
    if _RULE.match(line) and before.strip() and not _RULE.match(before) and len(line.strip()) > 1:
        found.append("underline")
    if after and _RULE.match(after) and line.strip() and len(after.strip()) > 1:
        found.append("underlined")
    if (_PIPES.match(after) or _PIPES.match(before) or line.strip().startswith("|")) and "|" in line:
        found.append("table")
    if (m := _BULLET.match(line)) and (_BULLET.match(before) or _BULLET.match(after)):
        found.append("list")
    return found


def inline(line: str) -> str:
    """A line without inline markup."""
    s = _COMMENT.sub("", line).replace("-->", "")
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x02{len(kept) - 1}\x03"

    s = _MATH.sub(keep, s)
    s = re.sub(r"<br\s*/?>", " ", s, flags=re.I)
    s = re.sub(r"</t[dh]>\s*<t[dh][^>]*>", " | ", s, flags=re.I)
    s = _TAG.sub("", s)
    s = _LINK.sub(lambda m: m[1] or m[2] or re.sub(r"^\s*\[[^\]]*\]:\s*", "", m[0]).strip("<>"), s)
    s = _CODE.sub(lambda m: m[2].strip(), s)
    s = re.sub(r"\[\[(?:Category|File|Image)\s*:[^\[\]]*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\{\{(?:[^{}|]*\|)?([^{}]*)\}\}", r"\1", s)
    s = re.sub(r"\[https?://\S+ ([^\]]*)\]", r"\1", s)
    s = re.sub(r"'''?([^'\n]+)'''?", r"\1", s)
    for _ in range(3):
        s = _STRONG.sub(lambda m: m[1] or m[2] or m[3], s)
        s = _EMPH.sub(lambda m: m[1] or m[2], s)
        s = re.sub(r"~?\\(?:ref|cite|label|eqref|pageref|usepackage|vspace|hspace|begin|end)\*?(?:\[[^\]]*\])*\{([^{}]*)\}", lambda m: f" {m[1]}" if "ref" in m[0] or "cite" in m[0] else "", s)
        s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])*\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\(?:hline|maketitle|tableofcontents|newline|noindent|par|centering|clearpage|newpage|\\)", "", s)
    s = re.sub(r"\\(LaTeX|TeX)(?:\{\})?", r"\1", s)
    s = re.sub(r"\\([%&_#{}$])", r"\1", s)
    s = html.unescape(s).replace("\xa0", " ")
    return re.sub(r"\x02(\d+)\x03", lambda m: formula(kept[int(m[1])]), s)


def formula(s: str) -> str:
    s = re.sub(r"</?math>", "", s.strip())
    for a, z in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")):
        if s.startswith(a) and s.endswith(z) and len(s) >= len(a) + len(z):
            return s[len(a) : -len(z)].strip()
    return s.strip()


def render(leaves, labels) -> tuple[str, list[tuple[str, str]]]:
    """(clean text, blocks as (kind, text)); neighbouring leaves of one kind make up a block."""
    blocks: list[list] = []
    for (line, _, fresh), k in zip(leaves, labels):
        name = LABELS[int(k)]
        if name == "syntax":
            if not blocks or blocks[-1][0] != "table":  # the rows of a table are one block, whatever rules are between them
                blocks.append(["", ""])
            continue
        kind = "paragraph" if name in ("text", "inline") else name
        if kind == "heading":
            s = inline(re.sub(r"^\s*#{1,6}\s+|\s+#+\s*$|^\s*=+\s*|\s*=+\s*$", "", line)).strip()
        elif kind == "list":
            s = "• " + inline(re.sub(r"^\s*\\item(?:\[[^\]]*\])?\s*", "", _BULLET.sub("", line))).strip()
        elif kind == "code":
            s = "    " + html.unescape(re.sub(r"</?(?:pre|code)[^>]*>", "", line, flags=re.I)).rstrip()
        elif kind == "table":
            cells = [inline(c).strip() for c in _CELLS.split(re.sub(r"^\s*[|!]\s*|\s*\|\s*$|\\\\.*$", "", line))]
            s = " | ".join(x for c in cells for x in c.split(" | ") if x)
        elif kind == "formula":
            s = inline(line).strip()
        else:
            s = inline(_QUOTE.sub("", line)).strip()
        if not s.strip(" •"):
            continue
        if blocks and blocks[-1][0] == kind and kind != "heading" and not (fresh and kind == "paragraph"):
            blocks[-1][1] += "\n" + s
        else:
            blocks.append([kind, s])
    done = [(k, s) for k, s in blocks if k]
    return "\n\n".join(s for _, s in done), done
