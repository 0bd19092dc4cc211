"""Queries over small planted files, for operators that SQL cannot express on the tables: what they must give is written out.

The files are part of the query; every extractor reads its own one, and the build resolves all of them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import dispatch
from ..extract.records import Emitter
from ..functions import paths
from ..operators import legacy

FILES = {
    "a/mod.py": "import os\nfrom .b import c as d\nLIMIT = 3\n\nclass Bus(Base):\n    \"\"\"Keeps the pins.\"\"\"\n    def open(self, pin):\n        return helper(pin)\n\ndef helper(pin: int) -> int:\n    return pin + LIMIT\n",
    "a/drv.c": "#include \"drv.h\"\n#include <kernel.h>\n#define SIZE 4\n/* Opens the port. */\nint port_open(struct dev *d, int n)\n{\n\treturn port_check(d) + SIZE;\n}\nstruct port {\n\tint id;\n};\nenum mode { A, B };\ntypedef unsigned int word_t;\nint port_check(struct dev *d);\n",
    "a/drv.h": "int port_open(struct dev *d, int n);\n",
    "a/Kconfig": "config PORT\n\tbool \"Port support\"\n\tdepends on BUS && !FAST\n\tselect POOL\n\tdefault y\n\thelp\n\t  Enables the port.\n\nconfig DEPTH\n\tint \"Depth\"\n\trange 1 9\n\tdefault 4\n",
    "a/prj.conf": "CONFIG_PORT=y\n# CONFIG_FAST is not set\nCONFIG_DEPTH=5\n",
    "a/board.dts": "/dts-v1/;\n#include \"soc.dtsi\"\n/ {\n\tmodel = \"x\";\n\tn1: port@10 {\n\t\tcompatible = \"acme,port\";\n\t\treg = <0x10 4>;\n\t\tclocks = <&clk 1>;\n\t\tstatus = \"okay\";\n\t};\n};\n&n1 { status = \"disabled\"; };\n",
    "a/soc.dtsi": "/ {\n\tclk: clock@1 {\n\t\tcompatible = \"acme,clk\";\n\t};\n};\n",
    "dts/bindings/acme,port.yaml": "description: Port of Acme\ncompatible: \"acme,port\"\ninclude: base.yaml\nproperties:\n  clocks:\n    type: phandle-array\n    required: true\n",
    "a/guide.rst": "Port guide\n==========\n\n.. _port-label:\n\nUsing it\n--------\n\nThe driver shall call :c:func:`port_open` first. See :option:`CONFIG_PORT` and ``port_check``.\n\n.. code-block:: c\n\n   port_open();\n",
    "a/README.md": "# Port\n\nThe port must be opened by `port_open` before use.\n\n## Notes\n\nSee [guide](guide.rst).\n",
}
LANGUAGES = {"a/mod.py": "python", "a/drv.c": "c", "a/drv.h": "c", "a/Kconfig": "kconfig-decl", "a/prj.conf": "kconfig-fragment", "a/board.dts": "devicetree", "a/soc.dtsi": "devicetree", "dts/bindings/acme,port.yaml": "dt-binding-yaml", "a/guide.rst": "rst", "a/README.md": "markdown"}
OLD = {
    "o/tool.py": "from x import y, z\nimport os.path\n\n\nclass Pin(Base, mod.Other):\n    def set(self):\n        flip(self)\n        self.go()\n\n\nasync def flip(p):\n    return p\n",
    "o/broken.py": "x = 1\ndef (:\n",
    "o/lib.js": "class Box extends Base {}\nfunction open(box) {\n  close(box);\n}\nfunction close(b) {}\n",
    "o/spec.md": "# Spec\n\nREQ-7: the link must come up.\nThe system shall keep the log.\nUse the API: open_port and see https://docs.invalid/a.\n",
}


def _frame(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(p, LANGUAGES.get(p), t) for p, t in files.items()], "source_file string, language string, content string")


def _brief(rows: DataFrame) -> DataFrame:
    """What a row says, in one shape for all kinds of rows."""
    which = lambda **by: F.coalesce(*(F.when(F.col("rec") == k, F.col(c)) for k, c in by.items()))
    return rows.select(
        "rec", which(entity="entity_type", relation="predicate", pending="pend_kind", ambiguity="entity_type").alias("kind"), which(entity="name", relation="subject", pending="subject", ambiguity="name").alias("a"),
        which(entity="kind", relation="object", pending="target", ambiguity="reason").alias("b"), F.coalesce("line", "line_start").alias("at"),
    )


def _extracted(path: str):
    return lambda s, d: _brief(dispatch.extract(_frame(s, {path: FILES[path]})))


def planted_registered(s, d):
    """A language registered on the driver is read by all workers."""

    def lines(path: str, text: str) -> Emitter:
        out = Emitter(path, "lines")
        for i, x in enumerate(text.splitlines(), 1):
            out.entity("Concept", x, i, i, "line")
        return out

    dispatch.register_extractor("lines", lines)
    try:
        return _brief(dispatch.extract(s.createDataFrame([("x.lines", "lines", "one\ntwo\n"), ("x.none", "none", "three")], "source_file string, language string, content string")))
    finally:
        del dispatch.EXTRACTORS["lines"]


def _build(s):
    from . import pipeline

    files = _frame(s, FILES)
    size = F.length("content")
    return pipeline.build(files.withColumns({"size_bytes": size.cast("long"), "sha256_hash": F.sha2("content", 256), "bucket": paths.bucket(F.col("language"), F.col("source_file"), F.lit(False)), "line_count": F.regexp_count("content", F.lit("\n")) + 1}))


def planted_relations(s, d):
    """Includes, calls, phandles, compatibles, roles, requirement windows and set options, resolved over all planted files."""
    return _build(s).graph().edges.where("type not in ('DECLARES', 'CONTAINS', 'HAS_CHUNK', 'HAS_SECTION')").select("type", F.col("start").alias("a"), F.col("end").alias("b"))


def planted_unresolved(s, d):
    return _build(s).unresolved.select("predicate", F.col("subject").alias("a"), F.col("object").alias("b"))


def u11_old_python(s, d):
    return legacy.python_rows(_frame(s, OLD))


def u13_requirements(s, d):
    return legacy.document_requirements(_frame(s, OLD).where("source_file like '%.md'"))


def u13_apis(s, d):
    return legacy.document_apis(_frame(s, OLD).where("source_file like '%.md'"))


def u12_generic_calls(s, d):
    f = _frame(s, OLD).where("source_file like '%.js'")
    return legacy.generic_calls(f, legacy.generic_symbols(f))


def u17_two_levels(s, d):
    return legacy.two_levels(_frame(s, OLD)).select("level", "source_file", "entity_type", "name")


_EXTRACTED = {"u01_python_rows": "a/mod.py", "u02_c_rows": "a/drv.c", "u03_kconfig_rows": "a/Kconfig", "u04_fragment_rows": "a/prj.conf", "u05_devicetree_rows": "a/board.dts", "u06_binding_rows": "dts/bindings/acme,port.yaml", "u07_rst_rows": "a/guide.rst", "u08_markdown_rows": "a/README.md"}
QUERIES = {k: _extracted(p) for k, p in _EXTRACTED.items()} | {f.__name__: f for f in (planted_registered, planted_relations, planted_unresolved, u11_old_python, u12_generic_calls, u13_requirements, u13_apis, u17_two_levels)}

# What the planted files must give, written from the rules of the data model.
_PY, _C, _K, _F, _D, _B = "SourceFile|a/mod.py", "SourceFile|a/drv.c", "SourceFile|a/Kconfig", "SourceFile|a/prj.conf", "SourceFile|a/board.dts", "SourceFile|dts/bindings/acme,port.yaml"
_OPEN, _N1, _RST, _MD = "Function|a/drv.c|port_open", "DTNode|a/board.dts|n1", "Document|a/guide.rst|guide.rst", "Document|a/README.md|README.md"
_SHALL, _MUST = "The driver shall call :c:func:`port_open` first.", "The port must be opened by `port_open` before use."
_WANT = {
    "u01_python_rows": [
        ("entity", "Class", "Bus", "definition", 5), ("entity", "Function", "open", "definition", 7), ("entity", "Function", "helper", "definition", 10), ("entity", "Variable", "LIMIT", "definition", 3),
        ("pending", "call", "Function|a/mod.py|open", "helper", 8), ("pending", "extends", "Class|a/mod.py|Bus", "Base", 5), ("pending", "import", _PY, "os", 1), ("pending", "import", _PY, "c", 2),
        ("relation", "DECLARES", _PY, "Variable|a/mod.py|LIMIT", 3), ("relation", "DECLARES", _PY, "Class|a/mod.py|Bus", 5), ("relation", "DECLARES", "Class|a/mod.py|Bus", "Function|a/mod.py|open", 7), ("relation", "DECLARES", _PY, "Function|a/mod.py|helper", 10),
    ],
    "u02_c_rows": [
        ("entity", "Macro", "SIZE", "object", 3), ("entity", "Function", "port_open", "definition", 5), ("entity", "Class", "port", "struct", 9), ("entity", "Type", "mode", "enum", 12), ("entity", "Type", "word_t", "typedef", 13), ("entity", "Function", "port_check", "declaration", 14),
        ("pending", "include", _C, "drv.h", 1), ("pending", "include", _C, "kernel.h", 2), ("pending", "call", _OPEN, "port_check", 7),
        ("relation", "DECLARES", _C, "Macro|a/drv.c|SIZE", 3), ("relation", "DECLARES", _C, _OPEN, 5), ("relation", "DECLARES", _C, "Class|a/drv.c|port", 9), ("relation", "DECLARES", _C, "Type|a/drv.c|mode", 12), ("relation", "DECLARES", _C, "Type|a/drv.c|word_t", 13), ("relation", "DECLARES", _C, "Function|a/drv.c|port_check", 14),
    ],
    "u03_kconfig_rows": [
        ("entity", "KconfigOption", "PORT", "declared", 1), ("entity", "KconfigOption", "DEPTH", "declared", 9), ("entity", "KconfigOption", "BUS", "stub", 3), ("entity", "KconfigOption", "FAST", "stub", 3), ("entity", "KconfigOption", "POOL", "stub", 4),
        ("relation", "DECLARES", _K, "KconfigOption|PORT", 1), ("relation", "DECLARES", _K, "KconfigOption|DEPTH", 9), ("relation", "DEPENDS_ON", "KconfigOption|PORT", "KconfigOption|BUS", 3), ("relation", "DEPENDS_ON", "KconfigOption|PORT", "KconfigOption|FAST", 3), ("relation", "SELECTS", "KconfigOption|PORT", "KconfigOption|POOL", 4),
    ],
    "u04_fragment_rows": [(("entity", "KconfigOption", n, "stub", i), ("relation", "SETS", _F, f"KconfigOption|{n}", i)) for i, n in ((1, "PORT"), (2, "FAST"), (3, "DEPTH"))],
    "u05_devicetree_rows": [
        ("entity", "DTNode", "/", "node", 3), ("entity", "DTNode", "n1", "node", 5), ("entity", "DTNode", "n1", "node-override", 12),
        ("pending", "include", _D, "soc.dtsi", 2), ("pending", "label", _N1, "n1", 5), ("pending", "compatible", _N1, "acme,port", 6), ("pending", "phandle", _N1, "clk", 8), ("pending", "phandle", _N1, "n1", 12),
        ("relation", "DECLARES", _D, "DTNode|a/board.dts|/", 3), ("relation", "DECLARES", _D, _N1, 5), ("relation", "CHILD_OF", _N1, "DTNode|a/board.dts|/", 5), ("relation", "DECLARES", _D, _N1, 12),
    ],
    "u06_binding_rows": [("entity", "DTBinding", "acme,port", "binding", 1), ("relation", "DECLARES", _B, "DTBinding|acme,port", 1)],
    "u07_rst_rows": [
        ("entity", "Document", "guide.rst", "", 1), ("entity", "Concept", "Port guide", "heading-0", 1), ("entity", "Concept", "Using it", "heading-1", 6), ("entity", "Requirement", _SHALL, "", 9),
        ("pending", "anchor", _RST, "port-label", 4), ("pending", "docref", _RST, "port_open", 9), ("pending", "docref", _RST, "CONFIG_PORT", 9), ("pending", "window", f"Requirement|a/guide.rst|{_SHALL}", "", 9),
        ("relation", "HAS_SECTION", _RST, "Concept|a/guide.rst|Port guide", 1), ("relation", "HAS_SECTION", _RST, "Concept|a/guide.rst|Using it", 6), ("relation", "CONTAINS", _RST, f"Requirement|a/guide.rst|{_SHALL}", 9),
    ],
    "u08_markdown_rows": [
        ("entity", "Document", "README.md", "", 1), ("entity", "Concept", "Port", "heading-1", 1), ("entity", "Concept", "Notes", "heading-2", 5), ("entity", "Requirement", _MUST, "", 3),
        ("pending", "docref", _MD, "port_open", 3), ("pending", "window", f"Requirement|a/README.md|{_MUST}", "", 3),
        ("relation", "HAS_SECTION", _MD, "Concept|a/README.md|Port", 1), ("relation", "HAS_SECTION", _MD, "Concept|a/README.md|Notes", 5), ("relation", "CONTAINS", _MD, f"Requirement|a/README.md|{_MUST}", 3),
    ],
    "planted_registered": [("entity", "Concept", "one", "line", 1), ("entity", "Concept", "two", "line", 2)],
    "planted_relations": [
        ("CALLS", _OPEN, "Function|a/drv.c|port_check"), ("CALLS", "Function|a/mod.py|open", "Function|a/mod.py|helper"), ("CHILD_OF", _N1, "DTNode|a/board.dts|/"), ("CHILD_OF", "DTNode|a/soc.dtsi|clk", "DTNode|a/soc.dtsi|/"), ("COMPATIBLE_WITH", _N1, "DTBinding|acme,port"),
        ("DEPENDS_ON", "KconfigOption|PORT", "KconfigOption|BUS"), ("DEPENDS_ON", "KconfigOption|PORT", "KconfigOption|FAST"), ("SELECTS", "KconfigOption|PORT", "KconfigOption|POOL"), ("INCLUDES", _D, "SourceFile|a/soc.dtsi"), ("INCLUDES", _C, "SourceFile|a/drv.h"), ("INCLUDES", _PY, "external:c"), ("INCLUDES", _PY, "external:os"),
        ("REFERENCES", _N1, _N1), ("REFERENCES", _N1, "DTNode|a/soc.dtsi|clk"), ("REFERENCES", _MD, _OPEN), ("REFERENCES", _RST, _OPEN), ("REFERENCES", _RST, "KconfigOption|PORT"),
        ("SATISFIES", f"Requirement|a/README.md|{_MUST}", _OPEN), ("SATISFIES", f"Requirement|a/guide.rst|{_SHALL}", _OPEN), ("SATISFIES", f"Requirement|a/guide.rst|{_SHALL}", "KconfigOption|PORT"),
        ("SETS", _F, "KconfigOption|PORT"), ("SETS", _F, "KconfigOption|FAST"), ("SETS", _F, "KconfigOption|DEPTH"),
    ],
    "u11_old_python": [
        ("o/broken.py", "ambiguity", "Module", "o/broken.py", "syntax error", 2, 0.35), ("o/tool.py", "entity", "Module", "tool.py", None, 1, 0.95), ("o/tool.py", "entity", "Class", "Pin", None, 5, 0.95), ("o/tool.py", "entity", "Function", "set", None, 6, 0.95), ("o/tool.py", "entity", "Function", "flip", None, 11, 0.95),
        ("o/tool.py", "relation", "CALLS", "set", "flip", 6, 0.85), ("o/tool.py", "relation", "CONTAINS", "tool.py", "Pin", 5, 0.95), ("o/tool.py", "relation", "CONTAINS", "tool.py", "set", 6, 0.95), ("o/tool.py", "relation", "CONTAINS", "tool.py", "flip", 11, 0.95),
        ("o/tool.py", "relation", "DEPENDS_ON", "tool.py", "y", 1, 0.95), ("o/tool.py", "relation", "DEPENDS_ON", "tool.py", "z", 1, 0.95), ("o/tool.py", "relation", "DEPENDS_ON", "tool.py", "os.path", 2, 0.95), ("o/tool.py", "relation", "EXTENDS", "Pin", "Base", 5, 0.95),
    ],
    "u12_generic_calls": [("o/lib.js", "open", 0.75), ("o/lib.js", "close", 0.75)],
    "u13_requirements": [("o/spec.md", "REQ-7 the link must come up.", 0.75), ("o/spec.md", "keep the log.", 0.75)],
    "u13_apis": [("o/spec.md", "open_port", 0.75)],
    "u17_two_levels": [
        (1, "o/lib.js", "Module", "lib.js"), (1, "o/lib.js", "Class", "Box"), (1, "o/lib.js", "Function", "open"), (1, "o/lib.js", "Function", "close"), (1, "o/tool.py", "Module", "tool.py"), (1, "o/tool.py", "Class", "Pin"), (1, "o/tool.py", "Function", "set"), (1, "o/tool.py", "Function", "flip"),
        (2, "o/spec.md", "Document", "spec.md"), (2, "o/spec.md", "Concept", "Spec"), (2, "o/spec.md", "Requirement", "REQ-7 the link must come up."), (2, "o/spec.md", "Requirement", "keep the log."), (2, "o/spec.md", "API", "open_port"),
    ],
}
_WANT["u04_fragment_rows"] = [r for both in _WANT["u04_fragment_rows"] for r in both]
_ROW = "rec, kind, a, b, at"
_NAMES = dict.fromkeys(_EXTRACTED, _ROW) | {"planted_registered": _ROW, "planted_relations": "type, a, b", "u11_old_python": "source_file, rec, kind, a, b, at, confidence", "u12_generic_calls": "source_file, name, confidence", "u13_requirements": "source_file, name, confidence", "u13_apis": "source_file, name, confidence", "u17_two_levels": "level, source_file, entity_type, name"}


def _literal(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


SQL = {k: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(f'"{c}"' for c in _NAMES[k].split(', '))})" for k, rows in _WANT.items()}
