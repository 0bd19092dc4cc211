"""References by every kind of role, in reST and in Markdown."""

from stratagraph.plans import q_tables


def test_all_roles_and_code_spans(spark, monkeypatch):
    rst = "Title\n=====\n\n.. _here:\n\nSee :c:func:`run`, :c:struct:`box`, :kconfig:option:`CONFIG_A=y`, :file:`src/a.c`, :ref:`here`, :c:func:`gone` and :term:`skipped`.\n"
    files = spark.createDataFrame([("d/x.rst", rst), ("d/y.md", "# T\n\nCall `run` or `nothing`.\n"), ("src/a.c", "int x;\n")], "source_file string, content string")
    ents = [("Function|src/a.c|run", "Function", "run", "src/a.c", "definition"), ("Class|src/a.c|box", "Class", "box", "src/a.c", "struct"), ("KconfigOption|A", "KconfigOption", "A", "Kconfig", "declared")]
    monkeypatch.setattr(q_tables, "_files", lambda s, d: files)
    monkeypatch.setattr(q_tables, "entities", lambda s, d: spark.createDataFrame(ents, "uid string, entity_type string, name string, source_file string, kind string"))
    got = {(r.source_file, r.role, r.target, (r.target_uid or "").split("|")[0]) for r in q_tables.QUERIES["j09_all_roles"](spark, "").collect()}
    x, y = "d/x.rst", "d/y.md"
    assert got == {
        (x, "c:func", None, "Function"), (x, "c:struct", None, "Class"), (x, "kconfig:option", None, "KconfigOption"), (x, "file", None, "SourceFile"), (x, "ref", None, "Document"),
        (x, "c:func", "gone", ""), (y, "code-span", None, "Function"), (y, "code-span", "nothing", ""),
    }
