"""Whether a text is a sentence of a language; the first error no reading recovers from."""

from __future__ import annotations

from functools import cache

from . import lr, scan

SUFFIXES = {
    ".py": "python", ".c": "c", ".h": "c", ".dts": "devicetree", ".dtsi": "devicetree", ".overlay": "devicetree",
    ".conf": "kconfig-fragment", ".yaml": "yaml", ".json": "json",
}
GRAMMARS = {"kconfig-fragment": "fragment"}


def language_of(path: str | None) -> str | None:
    """The language a path stands for, or None for kinds of file that are never judged."""
    name = (path or "").replace("\\", "/").rpartition("/")[2]
    dot = name.rfind(".")
    suffix = name[dot:] if dot >= 0 else ""
    if suffix == ".py":
        return "python"
    if name == "Kconfig" or name.startswith("Kconfig."):
        return "kconfig"
    if name.endswith("_defconfig"):
        return "kconfig-fragment"
    return SUFFIXES.get(suffix)


@cache
def _classes():
    t = lr.load("c").terminals
    return {t["NAME"]: (t["NAME"], t["TYPE"], t["ATTR"])}


def _ids(t: lr.Tables, kinds) -> list[int]:
    get = t.terminals.get
    return [get(k, -1) for k in kinds] + [t.terminals[lr.END]]


def first_error(language: str, text: str) -> int:
    """Offset of the first error in the text, or -1."""
    name = GRAMMARS.get(language, language)
    t = lr.load(name)
    if name in ("c", "devicetree"):
        for (kinds, at), body in getattr(scan, name)(text):
            if name == "c":
                i = lr.parse(t, _ids(t, scan.c_types(kinds)))
                if i >= 0:  # another reading of the names may do
                    i = lr.parse_all(t, _ids(t, kinds), _classes())
            else:
                i = lr.parse(t, _ids(t, kinds))
            if i >= 0:
                return at[i] if i < len(at) else len(body)
        return -1
    kinds, at, body = getattr(scan, name)(text)
    ids = _ids(t, kinds)
    i = lr.parse(t, ids)
    if i >= 0 and t.more:  # where the tables had a choice, another one may do
        i = lr.parse_all(t, ids, {})
    return -1 if i < 0 else at[i] if i < len(at) else len(body)
