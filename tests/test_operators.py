"""Core operators on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import paths, text
from stratagraph.operators import chunking, dedup, guard, incremental, legacy, metrics, resolve, retrieval, store
from stratagraph.operators.graph import PropertyGraph
from stratagraph.operators.symbols import pick_unique
from stratagraph.sources import inventory, records

SYM = "target_kind string, key string, uid string, file string, priority int"


def truth(cands, file):
    if not cands:
        return "none"
    if len(cands) == 1:
        return cands[0][0]
    same = [c for c in cands if c[1] == file]
    if len(same) == 1:
        return same[0][0]
    pool = same or cands
    top = max(c[2] for c in pool)
    best = [c for c in pool if c[2] == top]
    return best[0][0] if len(best) == 1 else "ambiguous"


def test_pick_unique_against_brute_force(spark):
    r = random.Random(5)
    syms = [("function", f"n{r.randint(0, 30)}", f"u{i}", f"f{r.randint(0, 4)}", r.randint(0, 3)) for i in range(90)]
    refs = [(i, "function", f"n{r.randint(0, 33)}", f"f{r.randint(0, 5)}", "x") for i in range(300)]
    got = pick_unique(spark.createDataFrame(refs, "id int, target_kind string, key string, file string, uid string"), spark.createDataFrame(syms, SYM))
    by = {x.id: x for x in got.collect()}
    assert len(by) == len(refs)
    for i, _, key, file, _ in refs:
        want = truth([(u, f, p) for _, k, u, f, p in syms if k == key], file)
        assert (by[i].target_uid if by[i].status == "ok" else by[i].status) == want


def test_dedup_rules(spark):
    e = spark.createDataFrame([("Function", "Foo", "a.c", "declaration", 1), ("Function", "foo", "a.c", "definition", 2), ("Function", "foo", "a.c", "definition", 3), ("Function", "foo", "b.c", None, 4), ("KconfigOption", "X", "a", "stub", 5), ("KconfigOption", "X", "b", "declared", 6)], "entity_type string, name string, source_file string, kind string, seq int")
    assert sorted(r.seq for r in dedup.best_entities(e, F.col("seq")).collect()) == [2, 4, 6]
    assert dedup.best_entities(dedup.best_entities(e, F.col("seq")), F.col("seq")).count() == 3
    rel = spark.createDataFrame([("a", "P", "b", "f", 1, 0.5), ("a", "P", "b", "f", 2, 0.4), ("a", "P", "b", "g", 3, 0.5)], "subject string, predicate string, object string, source_file string, seq int, confidence double")
    assert sorted(r.seq for r in dedup.last_relations(rel, F.col("seq")).collect()) == [2, 3]
    assert [r.seq for r in dedup.surest(rel, ["subject", "predicate", "object"], "confidence", F.col("seq")).collect()] == [1]
    assert [r.seq for r in dedup.merged_edges(rel, F.col("seq")).collect()] == [3]
    assert dedup.best_entities(e.limit(0), F.col("seq")).count() == 0


@pytest.mark.parametrize("content,spans", [("", [(1, 1)]), ("a", [(1, 1)]), ("a\n", [(1, 1)]), ("a\r\nb\rc", [(1, 2), (3, 3)]), ("a b\x0cc\n\n", [(1, 2), (3, 4)]), (None, [])])
def test_chunks_follow_splitlines(spark, content, spans):
    made = chunking.chunks(spark.createDataFrame([("f", content)], "source_file string, content string"), 2)
    rows = sorted(made.collect(), key=lambda r: r.line_start)
    assert [(r.line_start, r.line_end) for r in rows] == spans
    if content is not None:
        assert "".join(r.content for r in rows) == content
        lines = content.splitlines(keepends=True)
        assert [r.content for r in rows] == (["".join(lines[i : i + 2]) for i in range(0, len(lines), 2)] or [""])


def test_line_to_chunk(spark):
    f = spark.createDataFrame([("f", "\n".join(map(str, range(450))))], "source_file string, content string")
    made = chunking.chunks(f)
    got = chunking.chunk_of_line(spark.createDataFrame([("f", 200), ("f", 201), ("f", 9999), ("g", 1)], "source_file string, line_start int"), made)
    assert {(r.source_file, r.line_start): (r.source_chunk_uid or "").split("|")[2:3] for r in got.collect()} == {("f", 200): ["1-200"], ("f", 201): ["201-400"], ("f", 9999): [], ("g", 1): []}


def test_paths(spark):
    cases = {"a/b/../c.h": "a/c.h", "../x": "../x", "./a//b": "a/b", "a/../../b": "../b", "x": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", paths.normal(F.col("p")).alias("n")).collect()} == cases
    df = spark.createDataFrame([(".bashrc",), ("a.tar.gz",), ("x/Kconfig.net",), ("noext",), ("a.",), ("x/y/dts/bindings/u.yaml",), ("c/u.yaml",), ("t/a_defconfig",)], "p string")
    got = {r.p: (r.s, r.l) for r in df.select("p", paths.suffix(F.col("p")).alias("s"), paths.language(F.col("p")).alias("l")).collect()}
    assert got[".bashrc"][0] == "" and got["a.tar.gz"][0] == ".gz" and got["a."][0] == ""
    assert got["x/Kconfig.net"][1] == "kconfig-decl" and got["x/y/dts/bindings/u.yaml"][1] == "dt-binding-yaml" and got["c/u.yaml"][1] == "other" and got["t/a_defconfig"][1] == "kconfig-fragment"


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße", "aéb"), (None, None)], "a string, b string")
    rows = df.select(text.casefold(F.col("a")).alias("f"), text.ascii_json(F.struct("b")).alias("j"), text.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("n")).collect()
    assert rows[0].f == "strasse" and json.loads(rows[0].j) == {"b": "aéb"} and "\\u00e9" in rows[0].j and rows[0].n == 3 and rows[1].f is None


def test_inventory_of_a_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "a/b/x.c").write_bytes(b"int a;\n")
    (tmp_path / "a/img.bin").write_bytes(b"\x00\x01")
    (tmp_path / "l.txt").write_bytes(b"caf\xe9")
    (tmp_path / "e.txt").write_bytes(b"")
    files = inventory.with_text(inventory.scan(spark, str(tmp_path)))
    rows = {r.source_file: r for r in files.collect()}
    assert set(rows) == {"a/b/x.c", "a/img.bin", "l.txt", "e.txt"}
    assert rows["a/img.bin"].content is None and rows["a/img.bin"].line_count == 0 and rows["a/img.bin"].bucket == "binary"
    assert rows["l.txt"].content == "café" and rows["a/b/x.c"].line_count == 2 and rows["e.txt"].line_count == 0
    assert {(r.source_file, r.parent) for r in inventory.folders(files).collect()} == {(".", None), ("a", "."), ("a/b", "a")}
    assert inventory.empty_folders(str(tmp_path)) == ["empty"]
    assert inventory.contains_edges(files).count() == 2 + 4
    assert inventory.file_entities(files).count() == 4
    assert inventory.whitelisted(files).count() == 3
    inventory.write_access_log(files, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    bad = spark.createDataFrame([("../x",)], "source_file string")
    assert inventory.in_scope(bad).count() == 0
    with pytest.raises(Exception, match="outside the tree"):
        inventory.in_scope(bad, strict=True).collect()


def test_include_precedence(spark):
    files = spark.createDataFrame([("a/x.c",), ("a/m.h",), ("m.h",), ("inc/z/only.h",), ("p/dup.h",), ("q/dup.h",)], "source_file string")
    refs = spark.createDataFrame([("a/x.c", "m.h"), ("b/y.c", "m.h"), ("a/x.c", "z/only.h"), ("a/x.c", "dup.h"), ("a/x.c", "../m.h"), ("a/x.c", "none.h")], "source_file string, target string")
    got = {(r.source_file, r.target): r.resolved for r in resolve.resolve_includes(refs, files).collect()}
    assert got == {("a/x.c", "m.h"): "a/m.h", ("b/y.c", "m.h"): "m.h", ("a/x.c", "z/only.h"): "inc/z/only.h", ("a/x.c", "dup.h"): None, ("a/x.c", "../m.h"): "m.h", ("a/x.c", "none.h"): None}


def graph_of(spark, pairs, kind="CALLS"):
    n = sorted({x for p in pairs for x in p})
    return PropertyGraph(spark.createDataFrame([(x, "Function", x, "f") for x in n], "uid string, label string, name string, file string"), spark.createDataFrame([(kind, a, b) for a, b in pairs], "type string, start string, end string"))


def trails(pairs, a, b, most, least=1):
    out, front = [], [((a,), ())]
    for d in range(1, most + 1):
        front = [(c + (y,), t + ((x, y),)) for c, t in front for x, y in set(pairs) if x == c[-1] and (x, y) not in t]
        out += [c for c, _ in front if c[-1] == b and d >= least]
    return sorted(out)


def test_paths_and_cycles_are_trails(spark):
    r = random.Random(3)
    pairs = list({(r.choice("abcde"), r.choice("abcde")) for _ in range(13)})
    g = graph_of(spark, pairs)
    one = lambda u: spark.createDataFrame([(u,)], "uid string")
    for a, b in itertools.product("ab", "cd"):
        assert sorted(tuple(x.chain) for x in g.paths(["CALLS"], one(a), one(b), 4).collect()) == trails(pairs, a, b, 4)
    want = sorted(c for n in "abcde" for c in trails(pairs, n, n, 3, 2))
    assert sorted(tuple(x.chain) for x in g.cycles(["CALLS"], 2, 3).collect()) == want
    assert g.trace_dependency("a", "zzz", 3).count() == 0


def test_reach_degree_touching(spark):
    g = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "c"), ("d", "a")])
    seeds = spark.createDataFrame([("a",)], "uid string")
    assert {(r.uid, r.depth) for r in g.reachable(["CALLS"], seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.uid, r.depth) for r in g.reachable(["CALLS"], seeds, 5, backward=True).collect()} == {("a", 0), ("d", 1)}
    assert {r.uid: r.degree for r in g.degree().collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}
    assert g.touching(spark.createDataFrame([("c",), ("b",)], "uid string")).count() == 4
    assert {r.community for r in g.communities(4).where("uid in ('a', 'b')").collect()}
    assert abs(sum(r["rank"] for r in g.pagerank(5).collect()) - 4) < 0.5


def test_incremental(spark):
    M = "source_file string, sha256_hash string"
    diff = incremental.diff_manifest(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], M), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], M))
    assert {r.source_file: r.status for r in diff.collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "added"}
    rel = spark.createDataFrame([(1, "X|a|n", "X|b|n", "a"), (2, "X|a|n", "X|a|m", "a"), (3, "external", "X|a|n", "a"), (4, "X|a|n", "X|a|n", "c")], "i int, subject string, object string, source_file string")
    assert sorted(r.i for r in incremental.untouched_relations(rel, incremental.changed(diff)).collect()) == [2, 3]
    g = graph_of(spark, [("a", "b"), ("b", "c")])
    n, e = incremental.delete_nodes(g.nodes.withColumn("file", F.col("uid")), g.edges, spark.createDataFrame([("c",)], "source_file string"))
    assert n.count() == 2 and [(r.start, r.end) for r in e.collect()] == [("a", "b")]
    once = incremental.upsert(g.nodes, g.nodes.limit(1), ["uid"])
    assert once.count() == g.nodes.count() and incremental.upsert(once, g.nodes.limit(1), ["uid"]).count() == once.count()


def test_update_equals_full_run(spark):
    from stratagraph.extract.dispatch import extract
    from stratagraph.plans import pipeline

    def files(rows):
        df = spark.createDataFrame(rows, "source_file string, content string")
        sized = df.withColumns({"language": paths.language(F.col("source_file")), "size_bytes": F.length("content").cast("long"), "sha256_hash": F.sha2(F.col("content"), 256), "line_count": text.line_count(F.col("content"))})
        return sized.withColumn("bucket", F.lit("code"))

    old = [("a/x.c", "#include \"y.h\"\nint f(void)\n{\n\tg();\n\treturn 0;\n}\n"), ("a/y.h", "int g(void);\n"), ("a/z.c", "int g(void)\n{\n\treturn 1;\n}\n"), ("Kconfig", "config AAA\n\tbool\n\tselect BBB\n"), ("p.conf", "CONFIG_BBB=y\n")]
    new = [old[0], ("a/y.h", "int g(void);\nint h(void);\n"), ("Kconfig", "config BBB\n\tbool\n"), ("d.md", "# T\nUse `f` now. It must work here.\n")]
    seen = lambda b: (sorted((r.uid, r.kind) for r in b.entities.collect()), sorted((r.subject, r.predicate, r.object, r.confidence) for r in b.relations.collect()), sorted((r.entity_name, r.reason) for r in b.ambiguities.collect()))
    full = seen(pipeline.build(files(new)))
    first = pipeline.build(files(old))
    assert ("Function|a/x.c|f", "CALLS", "Function|a/z.c|g", 0.8) in seen(first)[1]
    assert ("SourceFile|a/x.c", "INCLUDES", "SourceFile|a/y.h", 1.0) in seen(first)[1]
    again, diff = pipeline.update(files(new), files(old).select("source_file", "sha256_hash"), extract(files(old)))
    assert {r.source_file: r.status for r in diff.collect()} == {"a/x.c": "unchanged", "a/y.h": "modified", "a/z.c": "removed", "Kconfig": "modified", "p.conf": "removed", "d.md": "added"}
    assert seen(again) == full
    g = first.graph()
    assert g.nodes.where("label = 'SourceChunk'").count() == 5
    assert pipeline.build(files(old).limit(0)).entities.count() == 0


def test_store_round_trip(spark, tmp_path):
    from stratagraph.schema import ENTITY

    e = spark.createDataFrame([("g", "Function", "a.c", 1, 2, "definition", "", "dé", "{}", "", "", "", ["x"]), ("f", "Function", "a.c", 1, 2, "definition", "", None, "{}", None, "", "", None)], ENTITY)
    store.export_records(e, "entities", str(tmp_path))
    back = records.read_records(spark, str(tmp_path), "entities")
    assert [(r.name, r.description) for r in back.orderBy("name").collect()] == [("f", None), ("g", "dé")]
    n = store.node_rows(e.withColumn("uid", F.concat(F.lit("Function|a.c|"), "name")))
    assert {r.name: r.text for r in n.collect()} == {"g": "dé", "f": "f"}
    edges = store.edge_rows(spark.createDataFrame([("u", "CALLS", "v")], "subject string, predicate string, object string").withColumns({c: F.lit(None).cast("string") for c in ("confidence", "source_file", "line", "rationale", "role", "metadata")}))
    store.write_graph(n, edges, str(tmp_path / "g"))
    store.append_graph(spark, n, edges, str(tmp_path / "g"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h/nodes")).count() == 2 and spark.read.parquet(str(tmp_path / "h/edges")).count() == 1
    with pytest.raises(Exception, match="bad predicate"):
        store.edge_rows(spark.createDataFrame([("u", "calls x", "v")], "subject string, predicate string, object string").withColumns({c: F.lit(None).cast("string") for c in ("confidence", "source_file", "line", "rationale", "role", "metadata")})).collect()
    store.export_report(e.select("name"), str(tmp_path / "rep"))
    assert sorted(len(r.value) > 0 for r in spark.read.text(str(tmp_path / "rep")).collect()) == [True, True, True]
    assert len(store.graph_schema(n, spark.createDataFrame([("CALLS", "A", "B")], "type string, start_label string, end_label string"))["indexes_created"]) == 20
    assert records.read_manifest(spark, str(tmp_path / "nothing")).count() == 0
    assert set(store.loggers()) == set(store.LOGGERS)
    log = store.run_suite(spark, {"ok": lambda: n.select("uid"), "bad": lambda: spark.table("no_such_table")}, str(tmp_path / "log"))
    assert [(r.operation, r.status) for r in log.collect()] == [("suite_start", "ok"), ("question", "ok"), ("question", "error"), ("suite_complete", "ok")]


def test_guard(spark):
    spark.range(300).createOrReplaceTempView("offset_dataset")
    assert len(guard.ask(spark, "SELECT id AS created FROM offset_dataset WHERE 'DROP' <> 'SET' ORDER BY id OFFSET 5")) == guard.MAX_ROWS
    for bad in ("DROP TABLE x", "CREATE TABLE x (a int)", "INSERT INTO x VALUES (1)", "MERGE INTO a USING b ON a.i = b.i WHEN MATCHED THEN DELETE", "SET a=b", "DELETE FROM x"):
        with pytest.raises(guard.NotReadOnly):
            guard.ask(spark, bad)
    n = spark.createDataFrame([("a", "internal", "x/y.py", "F", '{"language": "python"}'), ("b", None, "z", "F", None)], "uid string, kind string, file string, label string, metadata string")
    assert [r.uid for r in guard.without_internal(n).collect()] == ["b"]
    assert [r.uid for r in guard.prefiltered(n, "python", "^x/", "F").collect()] == ["a"]


def test_metrics(spark):
    g = graph_of(spark, [("a", "b"), ("a", "b"), ("b", "b")])
    assert [(r.uid, r.degree) for r in metrics.top_central(g.edges, 1).collect()] == [("b", 4)]
    assert metrics.isolated(g.nodes.unionByName(spark.createDataFrame([("z", "Function", "z", "f"), ("d", "Folder", "d", "d")], g.nodes.schema)), g.edges).select("uid").collect()[0].uid == "z"
    with pytest.raises(Exception, match="counts differ"):
        metrics.verify_counts(g.nodes, g.nodes.limit(1), "label").collect()
    long = "int f(void)\n{\n" + "\tx = 1;\n" * 120 + "}"
    f = spark.createDataFrame([("a", long), ("b", long.replace("\tx", "\t// y\n\tx", 1)), ("c", None)], "name string, source_text string")
    assert [r.name for r in metrics.long_uncommented(f).collect()] == ["a"]
    assert metrics.distinct_labels(g.nodes, g.edges).collect()[0].few_labels


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, None), (4, "")], "id int, t string")
    hits = retrieval.bm25(docs.where("t is not null"), "id", "t", "beta", 5).collect()
    assert [h.id for h in hits] == [1]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in retrieval.dense_search(v, [1.0, 0.1], 2).collect()] == [0, 2]
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id int, score double")
    b = spark.createDataFrame([(2, 9.0), (3, 1.0)], "id int, score double")
    assert [r.id for r in retrieval.fuse([a, b], "id", 3).collect()][0] == 2
    e = spark.createDataFrame([(0.9,), (0.7,), (0.2,)], "confidence double")
    assert [r.route for r in retrieval.route(e).collect()] == ["auto", "review", "reject"]
    t = retrieval.tokens(docs, "id", "t")
    assert {(r.id, r.term, r.tf) for r in t.collect()} == {(1, "alpha", 1), (1, "beta", 2), (2, "alpha", 1)}


def test_legacy(spark):
    f = spark.createDataFrame([("a.js", "class Foo {}\nfunction bar(x) {\n bar(1); if (x) baz();\n}\n#include <q.h>\nsee http://x.org/y"), ("b", None)], "source_file string, content string")
    s = legacy.generic_symbols(f)
    assert {("Class", "Foo"), ("Function", "bar")} <= {(r.entity_type, r.name) for r in s.collect()}
    assert {r.name for r in legacy.generic_calls(f, s).collect()} == {"bar"}
    assert {r.url for r in legacy.urls(f).collect()} == {"http://x.org/y"}
    rel = spark.createDataFrame([("a", "CALLS", "b", "f", 0.5), ("a", "CALLS", "b", "f", 0.9), ("a", "USES", "a", "f", 0.9), ("a", "CALLS", "c", "f", 0.9)], "subject string, predicate string, object string, source_file string, confidence double")
    e = spark.createDataFrame([("u1", "a", "f"), ("u2", "a", "g"), ("u3", "b", "g"), ("u4", "c", "x"), ("u5", "c", "y")], "uid string, name string, source_file string")
    good, bad = legacy.resolve_endpoints(rel, e)
    assert [(r.subject_uid, r.object_uid, r.confidence) for r in good.collect()] == [("u1", "u3", 0.9)]
    assert {r.reason for r in bad.collect()} == {"not exactly one candidate", "relation of a record with itself"}


def test_refresh_stream(spark, tmp_path):
    from stratagraph.streaming.refresh import refresh

    M = "source_file string, sha256_hash string, size_bytes long"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], M).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    seen = []
    apply = lambda batch, diff: seen.append({r.source_file: r.status for r in diff.collect()})
    run = lambda: refresh(spark.readStream.schema(M).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "m"), str(tmp_path / "c"), apply).awaitTermination()
    run()
    spark.createDataFrame([("b", "2", 1), ("c", "1", 1)], M).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    run()
    assert seen == [{"a": "added", "b": "added"}, {"b": "modified", "c": "added"}]
    assert records.read_manifest(spark, str(tmp_path / "m/1")).count() == 3
