"""Names are looked for in every kind of document file, and in the corpus."""

from stratagraph.plans import q_tables


def test_all_documents_are_read(spark, monkeypatch):
    files = spark.createDataFrame([(f"d/x.{e}", "calls Uart_init here") for e in ("rst", "md", "txt", "wiki", "html", "tex", "MD", "c")] + [("d/n.txt", None)], "source_file string, content string")
    docs = spark.createDataFrame([(7, "see uart_init()"), (8, None)], "doc_id long, text string")
    monkeypatch.setattr(q_tables, "table", lambda s, d, n: {"source_files": files, "documents": docs}[n])
    monkeypatch.setattr(q_tables, "entities", lambda s, d: spark.createDataFrame([("Function", "uart_init"), ("Macro", "here")], "entity_type string, name string"))
    got = sorted(tuple(r) for r in q_tables.QUERIES["j18_all_mentions"](spark, "").collect())
    assert got == sorted([("documents", "7", "uart_init"), *(("source_files", f"d/x.{e}", "uart_init") for e in ("rst", "md", "txt", "wiki", "html", "tex", "MD"))])
