"""Graph questions asked as text, each with the SQL that says the same."""

from __future__ import annotations

from .cypher import Cypher
from .graphs import WITH, graph
from .q_graph import _walk

TEXTS = {
    "c_labels": "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS total ORDER BY total DESC",
    "c_types": "MATCH ()-[r]->() RETURN type(r) AS kind, count(*) AS total",
    "c_filter": "MATCH (f:Function) WHERE (f.name CONTAINS 'uart' OR toLower(f.path) CONTAINS 'drivers') AND NOT f.kind = 'declaration' RETURN f.uid AS uid, f.line_start AS line",
    "c_inline": "MATCH (o:KconfigOption {kind: 'declared'})-[:DEPENDS_ON]->(p:KconfigOption) RETURN o.name AS option, p.name AS needs",
    "c_two_hops": "MATCH (s:SourceFile)-[:DECLARES]->(o:KconfigOption)-[:DEPENDS_ON]->(p:KconfigOption) RETURN p.name AS needed, count(DISTINCT s.uid) AS files",
    "c_converging": "MATCH (n:DTNode)-[:COMPATIBLE_WITH]->(b:DTBinding)<-[:DECLARES]-(f:SourceFile) RETURN b.name AS binding, count(*) AS nodes",
    "c_undirected": "MATCH (f:Function)-[r]-(other) WHERE f.name STARTS WITH 'adc' RETURN type(r) AS rel, count(*) AS n",
    "c_paths": "MATCH p = (a:Function)-[:CALLS*1..10]->(z:Function {name: 'log_emit'}) WHERE a.name STARTS WITH 'adc_arm' RETURN size(p) AS depth, a.uid AS first",
    "c_chain": "MATCH p = (a:Function)-[:CALLS*1..10]->(z:Function {name: 'log_emit'}) WHERE a.name STARTS WITH 'adc' WITH p, nodes(p) AS ns UNWIND ns AS n WITH p, collect(n.name) AS names RETURN names[0] AS first, size(p) AS depth",
    "c_call_trails": "MATCH p = (a:Function)-[:CALLS*1..10]->(z:Function {name: 'log_emit'}) WHERE a.name STARTS WITH 'adc_arm' RETURN size(p) AS depth, a.uid AS first",
    "c_call_chains": "MATCH p = (a:Function)-[:CALLS*1..10]->(z:Function {name: 'log_emit'}) WHERE a.name STARTS WITH 'adc' WITH p, nodes(p) AS ns UNWIND ns AS n WITH p, collect(n.name) AS names RETURN names[0] AS first, size(p) AS depth",
    "c_top": "MATCH (f:Function)-[c:CALLS]->(g:Function) RETURN g.uid AS uid, count(c) AS calls ORDER BY calls DESC, uid LIMIT 5",
    "c_with_where": "MATCH (f:SourceFile)-[:SETS]->(o:KconfigOption) WITH o.name AS option, count(*) AS files WHERE files > 1 RETURN option, files",
    "c_unwind": "UNWIND [1, 2, 3] AS x RETURN x, x * 2 AS y",
}


def _ask(text: str):
    return lambda s, d: Cypher(graph(s, d)).run(text)


QUERIES = {k: _ask(t) for k, t in TEXTS.items()}
_ADC = "s IN (SELECT uid FROM nodes WHERE label = 'Function' AND starts_with(name, '{}'))"
_LOG = "o IN (SELECT uid FROM nodes WHERE label = 'Function' AND name = 'log_emit')"
SQL = {
    "c_labels": f"{WITH} SELECT label, count(*) AS total FROM nodes GROUP BY 1",
    "c_types": f"{WITH} SELECT e.type AS kind, count(*) AS total FROM edges e JOIN nodes a ON e.s = a.uid JOIN nodes b ON e.o = b.uid GROUP BY 1",
    "c_filter": f"{WITH} SELECT uid, line_start AS line FROM nodes WHERE label = 'Function' AND (contains(name, 'uart') OR contains(lower(file), 'drivers')) AND NOT kind = 'declaration'",
    "c_inline": f"{WITH} SELECT a.name AS option, b.name AS needs FROM edges e JOIN nodes a ON e.s = a.uid JOIN nodes b ON e.o = b.uid WHERE e.type = 'DEPENDS_ON' AND a.label = 'KconfigOption' AND a.kind = 'declared' AND b.label = 'KconfigOption'",
    "c_two_hops": f"{WITH} SELECT c.name AS needed, count(DISTINCT a.uid) AS files FROM edges e JOIN nodes a ON e.s = a.uid AND a.label = 'SourceFile' JOIN nodes b ON e.o = b.uid AND b.label = 'KconfigOption' JOIN edges g ON g.s = b.uid AND g.type = 'DEPENDS_ON' JOIN nodes c ON g.o = c.uid AND c.label = 'KconfigOption' WHERE e.type = 'DECLARES' GROUP BY 1",
    "c_converging": f"{WITH} SELECT b.name AS binding, count(*) AS nodes FROM edges e JOIN nodes a ON e.s = a.uid AND a.label = 'DTNode' JOIN nodes b ON e.o = b.uid AND b.label = 'DTBinding' JOIN edges g ON g.o = b.uid AND g.type = 'DECLARES' JOIN nodes c ON g.s = c.uid AND c.label = 'SourceFile' WHERE e.type = 'COMPATIBLE_WITH' GROUP BY 1",
    "c_undirected": f"{WITH}, t AS (SELECT type, s AS a, o AS b FROM edges UNION ALL SELECT type, o, s FROM edges WHERE s <> o) SELECT t.type AS rel, count(*) AS n FROM t JOIN nodes f ON t.a = f.uid JOIN nodes g ON t.b = g.uid WHERE f.label = 'Function' AND starts_with(f.name, 'adc') GROUP BY 1",
    "c_paths": _walk("CALLS", 1, 10, _ADC.format("adc_arm"), _LOG).replace("SELECT chain, depth FROM walk", "SELECT depth, s AS first FROM walk"),
    "c_chain": _walk("CALLS", 1, 10, _ADC.format("adc"), _LOG).replace("SELECT chain, depth FROM walk", "SELECT split_part(s, '|', -1) AS first, depth FROM walk"),
    "c_call_trails": _walk("CALLS", 1, 10, _ADC.format("adc_arm"), _LOG).replace("SELECT chain, depth FROM walk", "SELECT depth, s AS first FROM walk"),
    "c_call_chains": _walk("CALLS", 1, 10, _ADC.format("adc"), _LOG).replace("SELECT chain, depth FROM walk", "SELECT split_part(s, '|', -1) AS first, depth FROM walk"),
    "c_top": f"{WITH} SELECT b.uid, count(*) AS calls FROM edges e JOIN nodes a ON e.s = a.uid AND a.label = 'Function' JOIN nodes b ON e.o = b.uid AND b.label = 'Function' WHERE e.type = 'CALLS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "c_with_where": f"{WITH} SELECT b.name AS option, count(*) AS files FROM edges e JOIN nodes a ON e.s = a.uid AND a.label = 'SourceFile' JOIN nodes b ON e.o = b.uid AND b.label = 'KconfigOption' WHERE e.type = 'SETS' GROUP BY 1 HAVING count(*) > 1",
    "c_unwind": "SELECT x, x * 2 AS y FROM (VALUES (1), (2), (3)) t(x)",
}
