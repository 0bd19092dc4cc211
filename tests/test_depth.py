"""Trails and cycles of the domain graph at the depths of the reference."""

from stratagraph.operators.graph import PropertyGraph
from stratagraph.plans import q_cypher, q_graph

NODES = "uid string, label string, name string, file string"


def test_trails_of_up_to_ten_calls_and_cycles_of_five(spark, monkeypatch):
    calls = [("F|adc_arm", "F|1"), *((f"F|{i}", f"F|{i + 1}") for i in range(1, 9)), ("F|9", "F|log_emit"), ("F|4", "F|log_emit"), ("F|log_emit", "F|7")]
    ring = [(f"S|{i}", f"S|{(i + 1) % 5}") for i in range(5)]
    ends = sorted({x for p in calls + ring for x in p})
    nodes = spark.createDataFrame([(x, "Function" if x[0] == "F" else "SourceFile", x[2:], "f") for x in ends], NODES)
    edges = spark.createDataFrame([("CALLS", a, b) for a, b in calls] + [("INCLUDES", a, b) for a, b in ring] + [("CALLS", a, b) for a, b in ring], "type string, start string, end string")
    for m in (q_graph, q_cypher):
        monkeypatch.setattr(m, "graph", lambda s, d: PropertyGraph(nodes, edges))
    # 5 calls; the same and round log_emit > 7 > 8 > 9 > log_emit; 10 calls straight on
    got = sorted(r.depth for r in q_graph.QUERIES["g01_call_trails"](spark, "").collect())
    assert got == [5, 9, 10]
    assert [r.depth for r in q_graph.QUERIES["g01_shortest_trails"](spark, "").collect()] == [5, 9, 10]
    assert sorted(r.depth for r in q_cypher.QUERIES["c_call_trails"](spark, "").collect()) == got
    assert sorted(tuple(r) for r in q_cypher.QUERIES["c_call_chains"](spark, "").collect()) == [("adc_arm", n) for n in got]
    want = sorted(" > ".join(f"S|{(i + k) % 5}" for k in range(6)) for i in range(5))
    assert sorted(r.chain for r in q_graph.QUERIES["g02_include_cycles"](spark, "").collect()) == want
    assert set(want) < {r.chain for r in q_graph.QUERIES["g02_call_cycles"](spark, "").collect()}
