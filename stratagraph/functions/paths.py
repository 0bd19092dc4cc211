"""Scalar functions on paths with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which suffixes belong to which language.
C_SUFFIXES = (".c", ".h")
CPP_SUFFIXES = (".cc", ".cpp", ".cxx", ".hh", ".hpp", ".ipp")
DT_SUFFIXES = (".dts", ".dtsi", ".overlay")
MARKDOWN_SUFFIXES = (".md", ".markdown")
YAML_SUFFIXES = (".yaml", ".yml")
CONFIG_SUFFIXES = (".yaml", ".yml", ".json", ".toml", ".ini", ".cfg")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; none for names that only start with a dot, or end with one."""
    return F.regexp_extract(name(path), r"[^.](\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """The folder of a path; ``.`` at the top, and null above it."""
    cut = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(path == ".", F.lit(None)).when(cut == "", F.lit(".")).otherwise(cut)


def ancestors(path: Column) -> Column:
    """All folders above a path, ``.`` included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))


def suffixes(path: Column) -> Column:
    """Every tail of a path that starts at a folder boundary, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def normal(path: Column) -> Column:
    """``.`` and ``..`` folded; a ``..`` above the top stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # the list starts with an empty part, so its last element can always be asked for
    back = lambda acc, p: (p == "..") & ~F.element_at(acc, -1).isin("", "..")
    step = lambda acc, p: F.when(back(acc, p), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    folded = F.aggregate(parts, F.array(F.lit("")), step)
    return F.array_join(F.filter(folded, lambda p: p != ""), "/")


def language(path: Column) -> Column:
    """Classification of a path; the order of the rules matters."""
    s, n = F.lower(suffix(path)), name(path)
    return (
        F.when(s == ".py", "python").when(s.isin(*C_SUFFIXES), "c").when(s.isin(*CPP_SUFFIXES), "cpp")
        .when((n == "Kconfig") | n.startswith("Kconfig."), "kconfig-decl")
        .when(s.isin(".conf", ".defconfig") | n.endswith("_defconfig"), "kconfig-fragment")
        .when(s.isin(*DT_SUFFIXES), "devicetree")
        .when(s.isin(*YAML_SUFFIXES) & F.concat(F.lit("/"), path).contains("/dts/bindings/"), "dt-binding-yaml")
        .when(s == ".rst", "rst").when(s.isin(*MARKDOWN_SUFFIXES), "markdown").otherwise("other")
    )


def bucket(lang: Column, path: Column, binary: Column) -> Column:
    return (
        F.when(binary, "binary").when(lang.isin("python", "c", "cpp"), "code")
        .when(lang.isin("kconfig-decl", "kconfig-fragment", "devicetree", "dt-binding-yaml"), "config")
        .when(lang.isin("rst", "markdown"), "doc").when(F.lower(suffix(path)).isin(*CONFIG_SUFFIXES), "config").otherwise("other")
    )
