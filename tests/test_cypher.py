"""Graph questions as text."""

import pytest

from stratagraph.operators.graph import PropertyGraph
from stratagraph.plans.cypher import Cypher, CypherError, Reader


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("F|a", "Function", "a", "x/drivers/a.c", 1, "definition", '{"language": "c"}'), ("F|b", "Function", "b", "x/b.c", 2, None, None), ("F|c", "Function", "c", "y/c.c", 3, "declaration", "{}"), ("S|s", "SourceFile", "s", "y/s", 1, "", "{}"), ("S|t", "SourceFile", "t", "y/t", 1, "", "{}")]
    edges = [("CALLS", "F|a", "F|b"), ("CALLS", "F|b", "F|c"), ("CALLS", "F|c", "F|a"), ("CALLS", "F|c", "F|c"), ("INCLUDES", "S|s", "S|t"), ("INCLUDES", "S|t", "S|s"), ("CALLS", "F|a", "F|missing")]
    return PropertyGraph(spark.createDataFrame(nodes, "uid string, label string, name string, file string, line_start int, kind string, metadata string"), spark.createDataFrame(edges, "type string, start string, end string"))


def ask(g, text, **params):
    return [tuple(r) for r in Cypher(g, **params).run(text).collect()]


def test_patterns(g):
    assert sorted(ask(g, "MATCH (f:Function)-[:CALLS]->(h:Function) RETURN f.name, h.name")) == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")]
    assert sorted(ask(g, "MATCH (f:Function)<-[:CALLS]-(h:Function) RETURN f.name, h.name")) == [("a", "c"), ("b", "a"), ("c", "b"), ("c", "c")]
    assert sorted(ask(g, "MATCH (f {name: 'c'})-[r]-(o) RETURN type(r), o.name")) == [("CALLS", "a"), ("CALLS", "b"), ("CALLS", "c")]
    assert ask(g, "MATCH (f:Function {name: $n})-[:CALLS]->(x)-[:CALLS]->(y) RETURN y.uid AS u", n="a") == [("F|c",)]
    assert ask(g, "MATCH (a)-[:CALLS]->(b)<-[:CALLS]-(c) WHERE a.name = 'b' AND c.name = 'c' RETURN b.name") == [("c",)]
    assert ask(g, "MATCH (a)-[:CALLS]->(a) RETURN a.name") == [("c",)]
    assert sorted(ask(g, "MATCH (a:Function {name: 'a'})-[:CALLS]->(b), (b)-[:CALLS]->(c) RETURN c.name")) == [("c",)]


def test_paths(g):
    assert ask(g, "MATCH p = (a:Function {name: 'a'})-[:CALLS*1..3]->(z:Function {name: 'c'}) RETURN size(p) AS depth ORDER BY size(p) ASC LIMIT 1") == [(2,)]
    rows = ask(g, "MATCH path = (a:Function {name: 'a'})-[:CALLS*1..2]->(z {name: 'c'}) WITH path, nodes(path) AS ns, relationships(path) AS rels UNWIND ns AS n WITH path, rels, COLLECT(n.uid) AS chain, COLLECT(n.file) AS files RETURN chain, files, size(path) AS depth, size(rels) AS edges")
    assert rows == [(["F|a", "F|b", "F|c"], ["x/drivers/a.c", "x/b.c", "y/c.c"], 2, 2)]
    cyc = ask(g, "MATCH path = (sf:SourceFile)-[:INCLUDES*2..5]->(sf) WITH path, nodes(path) AS ns UNWIND ns AS n WITH path, COLLECT(n.path) AS c RETURN c, size(path) AS len ORDER BY len ASC LIMIT 10")
    assert sorted(cyc) == [(["y/s", "y/t", "y/s"], 2), (["y/t", "y/s", "y/t"], 2)]


def test_expressions(g):
    assert ask(g, "MATCH (f:Function) WHERE (f.name CONTAINS 'a' OR toLower(f.path) ENDS WITH 'B.C') AND NOT f.kind = 'declaration' RETURN f.name") == [("a",)]
    assert ask(g, "MATCH (f) WHERE f.kind IS NULL RETURN f.name") == [("b",)]
    assert ask(g, "MATCH (f) WHERE f.language = 'c' RETURN f.title, labels(f)") == [("a", ["Function"])]
    assert ask(g, "MATCH (f) WHERE f.name IN ['a', 'zz'] AND f.line_start >= 1 RETURN f.name + '!' AS n, coalesce(f.kind, 'x')") == [("a!", "definition")]
    assert ask(g, "MATCH (n) UNWIND labels(n) AS l RETURN l, count(*) AS c ORDER BY c DESC, l LIMIT 1") == [("Function", 3)]
    assert ask(g, "MATCH (n) RETURN count(DISTINCT labels(n)[0]) AS c") == [(2,)]
    assert ask(g, "MATCH (n:Function) WITH n.name AS x WHERE x <> 'a' RETURN DISTINCT x ORDER BY x SKIP 1") == [("c",)]
    assert ask(g, "MATCH (b:Board)-[:SUPPORTS]->(p:Peripheral) RETURN b.id AS i, p.compatible AS c") == []


@pytest.mark.parametrize("text", ["CREATE (n:X)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1", "MATCH (n) DETACH DELETE n", "MERGE (n:X {a: 1})", "MATCH (n) REMOVE n.x", "DROP INDEX i", "MATCH (a)-[:T*]->(b) RETURN a", "MATCH (a) RETURN b.x", "MATCH (a), (b) RETURN a.x", "", "MATCH (n RETURN n", "MATCH (n) RETURN f(n)", "CALL x.y()"])
def test_what_is_refused(g, text):
    with pytest.raises(CypherError):
        Cypher(g).run(text).collect()


def test_words_inside_names_are_no_clauses():
    assert Reader("MATCH (n {offset: 'CREATE SET DELETE'}) RETURN n.dataset").pattern
