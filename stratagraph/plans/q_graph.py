"""Queries on the graph: inventories, patterns, traversal, reports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import table
from ..operators import dedup, metrics, resolve, retrieval, store
from ..operators.graph import PropertyGraph
from .graphs import WITH, edges, entities, graph, nodes, relations


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Edges with the labels of both ends."""
    rel = edges(s, d).withColumnsRenamed({"start": "subject", "end": "object"})
    return resolve.labelled_edges(rel, nodes(s, d))[0]


def q01_node_inventory(s, d):
    return metrics.label_counts(nodes(s, d)).select(F.array("label").alias("labels"), "count").select(F.array_join("labels", ",").alias("labels"), "count")


def q02_edge_inventory(s, d):
    return metrics.type_counts(edges(s, d)).withColumnRenamed("type", "relationship")


def q03_documents_containing(s, d, word="beacon"):
    n = graph(s, d).node("Document")
    return n.where(F.lower("file").contains(word) | F.lower("name").contains(word)).select(F.col("file").alias("path"), F.col("name").alias("title")).orderBy("path", "title")


def q04_driver_functions(s, d):
    return graph(s, d).node("Function").where(F.lower("file").contains("drivers")).select("name", "file", "kind").orderBy("file", "name", "kind")


def q05_peripherals(s, d):
    return graph(s, d).node("HardwarePeripheral").where(F.lower(F.get_json_object("metadata", "$.compatible")).contains("uart")).select(F.get_json_object("metadata", "$.compatible").alias("compatible"), F.col("file").alias("source_file"))


def q06_boards(s, d):
    return graph(s, d).node("Board").where(F.lower("uid").contains("nrf") | F.lower("name").contains("nrf")).select(F.col("uid").alias("id"), "name", F.col("file").alias("path"))


def _pairs(s, d, a, types, b):
    g = graph(s, d)
    keep = ["uid", "name", "file"]
    left, right = g.node(a).select(*(F.col(c).alias("a_" + c) for c in keep)), g.node(b).select(*(F.col(c).alias("b_" + c) for c in keep))
    return g.hop(left, types, right)


def q07_board_support(s, d):
    return _pairs(s, d, "Board", ["SUPPORTS"], "HardwarePeripheral").select(F.col("a_uid").alias("board_id"), F.col("a_name").alias("board_name"), F.col("b_name").alias("peripheral"))


def q08_function_usage(s, d):
    return _pairs(s, d, "Function", ["USES"], "HardwarePeripheral").select(F.col("a_name").alias("function"), F.col("a_file").alias("file"), F.col("b_name").alias("peripheral"))


def q09_document_descriptions(s, d):
    return _pairs(s, d, "Document", ["DESCRIBES"], "Function").where(F.lower("b_name").contains("printk")).select(F.col("a_file").alias("document"), F.col("b_name").alias("function"), F.col("b_file").alias("file"))


def q10_call_graph(s, d):
    return _pairs(s, d, "Function", ["CALLS"], "Function").select(F.col("a_name").alias("caller"), F.col("a_file").alias("caller_file"), F.col("b_name").alias("callee"), F.col("b_file").alias("callee_file")).orderBy("caller_file", "caller", "callee_file", "callee")


def t1_uart_functions(s, d):
    return graph(s, d).node("Function").where(F.col("name").contains("uart")).select("name", "file", "kind")


def t2_edges_at_uart(s, d):
    g = graph(s, d)
    return g.touching(g.node("Function").where(F.col("name").contains("uart"))).groupBy(F.col("type").alias("rel_type")).agg(F.count("*").alias("count"))


def t3_documents(s, d):
    return graph(s, d).node("Document").select(F.col("file").alias("path"), "description").orderBy("path", "description").limit(10)


def t4_requirements(s, d):
    return graph(s, d).node("Requirement").select(F.col("description").alias("text"), F.col("file").alias("source"), "uid").orderBy("uid").limit(10)


def t5_and_or_filter(s, d):
    n = graph(s, d).node("Function")
    return n.where((F.col("name").contains("uart") | F.col("file").contains("uart")) & (F.col("name").contains("init") | F.col("name").contains("reset") | F.col("name").contains("poll"))).select(F.col("uid").alias("function_uid"), F.col("name").alias("function_name"), "file", "line_start", "kind")


def t6_call_paths(s, d, most=10):
    g = graph(s, d)
    a = g.node("Function").where(F.col("name").startswith("adc_arm"))
    b = g.node("Function").where(F.col("name") == "log_emit")
    return g.paths(["CALLS"], a, b, most).select(F.array_join("chain", " > ").alias("chain"), "depth")


def t6_shortest(s, d):
    return t6_call_paths(s, d).orderBy("depth", "chain").limit(5)


def t7_include_cycles(s, d):
    return graph(s, d).cycles(["INCLUDES"], 2, 5).select(F.array_join("chain", " > ").alias("chain"), "depth")


def t7_call_cycles(s, d):
    return graph(s, d).cycles(["CALLS"], 2, 5).select(F.array_join("chain", " > ").alias("chain"), "depth")


def g01_call_trails(s, d):
    """t6 at the depth of the reference, CALLS*1..10."""
    return t6_call_paths(s, d, most=10)


def g01_shortest_trails(s, d):
    return g01_call_trails(s, d).orderBy("depth", "chain").limit(5)


def g02_include_cycles(s, d):
    """t7 at the depth of the reference, INCLUDES*2..5."""
    return graph(s, d).cycles(["INCLUDES"], 2, 5).select(F.array_join("chain", " > ").alias("chain"), "depth")


def g02_call_cycles(s, d):
    return graph(s, d).cycles(["CALLS"], 2, 5).select(F.array_join("chain", " > ").alias("chain"), "depth")


def d1_node_to_binding(s, d):
    return _pairs(s, d, "DTNode", ["COMPATIBLE_WITH"], "DTBinding").where(F.col("a_name").startswith("uart")).select(F.col("a_name").alias("node"), F.col("b_name").alias("binding"))


def d2_unwound_labels(s, d):
    return nodes(s, d).select(F.explode(F.array("label")).alias("label")).groupBy("label").agg(F.count("*").alias("count"))


def r1_converging(s, d):
    """(file)-[:SETS]->(option)<-[:DEPENDS_ON]-(dependent): both sides are summed up per option before they meet."""
    g = graph(s, d)
    a = g.edge("SETS").groupBy(F.col("end").alias("option")).agg(F.count("*").alias("files"))
    b = g.edge("DEPENDS_ON").groupBy(F.col("end").alias("option")).agg(F.count("*").alias("dependents"))
    return a.join(b, "option")


def r2_two_hops(s, d):
    """(document)-[:REFERENCES]->(function)-[:CALLS]->(function), with a word in the document's name."""
    g = graph(s, d)
    docs = g.node("Document").where(F.lower("name").contains("e")).select(F.col("uid").alias("document"))
    one = g.edge("REFERENCES").join(docs, F.col("start") == F.col("document")).select("document", F.col("end").alias("mid"))
    two = g.edge("CALLS").select(F.col("start").alias("mid"), F.col("end").alias("callee"))
    return one.join(two, "mid").select("document", "mid", "callee").distinct()


def g03_callers(s, d):
    g = graph(s, d)
    return g.callers(g.node("Function").where(F.col("name").contains("flush")))


def g06_subtree(s, d):
    """Everything below the folders of the second level, with the least depth."""
    g = graph(s, d)
    return g.reachable(["CONTAINS"], g.node("Folder").where(F.col("file").rlike("^[^/]+/[^/]+$")), 8)


def a01_best_entities(s, d):
    e = entities(s, d).dropDuplicates(["entity_id"])
    return dedup.best_entities(e, F.col("entity_id")).select("uid", "kind", "entity_id")


def a02_last_relations(s, d):
    r = relations(s, d)
    return dedup.last_relations(r, F.struct("ingested_at", "relation_id")).select("relation_id", "subject", "predicate", "object", "source_file")


def a03_surest_relations(s, d):
    return dedup.surest(relations(s, d), ["subject", "predicate", "object"], "confidence", F.col("relation_id")).select("relation_id", "confidence")


def a04_degree(s, d):
    return graph(s, d).degree()


def a05_isolated(s, d):
    g = graph(s, d)
    return metrics.isolated(g.nodes, g.edges).groupBy("label").agg(F.count("*").alias("isolated"))


def a06_type_distribution(s, d):
    return entities(s, d).groupBy("entity_type", "kind").agg(F.count("*").alias("count"))


def a08_completeness(s, d):
    return metrics.completeness(table(s, d, "source_files"), nodes(s, d))


def a09_label_sets(s, d):
    return metrics.label_sets(_labelled(s, d)).select("type", "count", F.array_join("start_labels", ",").alias("start_labels"), F.array_join("end_labels", ",").alias("end_labels"))


def a10_schema_nodes(s, d):
    return metrics.schema_nodes(nodes(s, d)).select("label", "count", F.size("required_properties").alias("required"))


def a11_confidence_histogram(s, d):
    return metrics.confidence_histogram(relations(s, d))


def a12_cross_links(s, d):
    return metrics.cross_links(edges(s, d))


def a15_totals(s, d):
    one = lambda df, name: df.agg(F.count("*").alias("total")).select(F.lit(name).alias("what"), "total")
    return one(nodes(s, d), "nodes").unionByName(one(edges(s, d), "relationships"))


def a16_distinct_labels(s, d):
    return metrics.distinct_labels(nodes(s, d), edges(s, d))


def a18_collect(s, d):
    """Names of the options each option depends on, as one list."""
    e = edges(s, d).where("type = 'DEPENDS_ON'").select("start", F.substring_index("end", "|", -1).alias("name"))
    return e.groupBy("start").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("needs"))


def a19_merged_edges(s, d):
    return edges(s, d).select("type", "start", "end", "confidence", "line").withColumnsRenamed({"start": "s", "end": "o"})


def o03_top_central(s, d):
    return metrics.top_central(edges(s, d), 10)


def j11_skipped_ends(s, d):
    rel = edges(s, d).withColumnsRenamed({"start": "subject", "end": "object"})
    return resolve.labelled_edges(rel, nodes(s, d))[1].groupBy("type").agg(F.count("*").alias("skipped"))


def j12_has_chunk(s, d):
    e = store.has_chunk_edges(table(s, d, "source_chunks"), nodes(s, d))
    return e.select("type", F.col("start").alias("s"), F.col("end").alias("o"))


def j08_stub_options(s, d):
    return resolve.stub_options(entities(s, d), relations(s, d))


def proj_node_rows(s, d):
    """Node projection with the text fallback and JSON parameters."""
    e = entities(s, d).dropDuplicates(["entity_id"])
    return store.node_rows(e.withColumn("id", F.col("entity_id"))).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("text_chars"))


def v09_route(s, d):
    return retrieval.route(relations(s, d)).groupBy("route", "flagged").agg(F.count("*").alias("n"))


def v09_versions(s, d):
    e = entities(s, d).dropDuplicates(["entity_id"])
    v = retrieval.versions(e)
    return v.select("entity_id", "uid", "valid_from", "valid_to")


def sweep_stubs(s, d):
    return metrics.stub_sweep(entities(s, d)).distinct()


def sweep_unsure(s, d):
    return metrics.unsure_sweep(relations(s, d)).select("relation_id", "confidence")


def sweep_degree_zero(s, d):
    e, r = entities(s, d), relations(s, d)
    return metrics.degree_zero_sweep(e, r).groupBy("entity_type").agg(F.count("*").alias("n"))


def sweep_long_uncommented(s, d):
    e = entities(s, d).where("entity_type = 'Function' and kind = 'definition'").dropDuplicates(["entity_id"])
    return metrics.long_uncommented(e).select("entity_id", "name")


def sweep_uncommented_20(s, d):
    e = entities(s, d).where("entity_type = 'Function' and kind = 'definition'").dropDuplicates(["entity_id"])
    return metrics.long_uncommented(e, lines=20).select("entity_id", "name")


def g05_communities(s, d):
    g = graph(s, d)
    n = g.node("KconfigOption").select("uid")
    e = g.edge("DEPENDS_ON", "SELECTS").select("type", "start", "end")
    return PropertyGraph(n.unionByName(e.select(F.col("end").alias("uid"))).distinct(), e).communities(3)


def g05_pagerank(s, d):
    g = graph(s, d)
    e = g.edge("CALLS").select("type", "start", "end")
    n = e.select(F.explode(F.array("start", "end")).alias("uid")).distinct()
    return PropertyGraph(n, e).pagerank(4).select("uid", F.round("rank", 10).alias("rank"))


def _events(s, d):
    """Event types as nodes, and which type followed which for some user as edges: a small graph full of cycles."""
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = e.select(F.col("event_type").alias("start"), F.lead("event_type").over(w).alias("end")).where("end is not null").distinct()
    n = e.select(F.col("event_type").alias("uid")).distinct()
    return PropertyGraph(n.select("uid", F.lit("Event").alias("label")), pairs.select(F.lit("NEXT").alias("type"), "start", "end"))


def g01_event_paths(s, d):
    g = _events(s, d)
    return g.paths(["NEXT"], g.nodes.where("uid = 'signup'"), g.nodes.where("uid = 'purchase'"), 3).select(F.array_join("chain", " > ").alias("chain"), "depth")


def g02_event_cycles(s, d):
    return _events(s, d).cycles(["NEXT"], 2, 3).select(F.array_join("chain", " > ").alias("chain"), "depth")


QUERIES = {f.__name__: f for f in (
    g01_event_paths, g02_event_cycles, q01_node_inventory, q02_edge_inventory, q03_documents_containing, q04_driver_functions, q05_peripherals, q06_boards, q07_board_support, q08_function_usage, q09_document_descriptions, q10_call_graph,
    t1_uart_functions, t2_edges_at_uart, t3_documents, t4_requirements, t5_and_or_filter, t6_call_paths, t6_shortest, t7_include_cycles, t7_call_cycles, g01_call_trails, g01_shortest_trails, g02_include_cycles, g02_call_cycles, d1_node_to_binding, d2_unwound_labels, r1_converging, r2_two_hops, g03_callers, g06_subtree,
    a01_best_entities, a02_last_relations, a03_surest_relations, a04_degree, a05_isolated, a06_type_distribution, a08_completeness, a09_label_sets, a10_schema_nodes, a11_confidence_histogram, a12_cross_links, a15_totals, a16_distinct_labels, a18_collect, a19_merged_edges,
    o03_top_central, j08_stub_options, j11_skipped_ends, j12_has_chunk, proj_node_rows, v09_route, v09_versions, sweep_stubs, sweep_unsure, sweep_degree_zero, sweep_long_uncommented, sweep_uncommented_20, g05_communities, g05_pagerank,
)}

_PRIO = "CASE coalesce(kind, '') WHEN 'definition' THEN 3 WHEN 'struct' THEN 3 WHEN 'union' THEN 3 WHEN 'enum' THEN 3 WHEN 'typedef' THEN 3 WHEN 'node' THEN 3 WHEN 'declared' THEN 3 WHEN 'referenced' THEN 1 WHEN 'stub' THEN 0 ELSE 2 END"
_PAIR = "SELECT {cols} FROM edges e JOIN nodes a ON e.s = a.uid AND a.label = '{a}' JOIN nodes b ON e.o = b.uid AND b.label = '{b}' WHERE e.type = '{t}'"
_REQUIRED = ", ".join(f"('{k}', {len(v)})" for k, v in metrics.REQUIRED.items())
_CROSS = ", ".join(f"'{x}'" for x in metrics.CROSS_LINKS)


def _walk(types: str, least: int, most: int, first: str, last: str) -> str:
    return f"""{WITH}, e AS (SELECT DISTINCT s, o FROM edges WHERE type = '{types}'),
walk(s, o, chain, trail, depth) AS (
  SELECT s, o, s || ' > ' || o, [s || chr(1) || o], 1 FROM e WHERE {first}
  UNION ALL SELECT w.s, e.o, w.chain || ' > ' || e.o, list_append(w.trail, e.s || chr(1) || e.o), w.depth + 1 FROM walk w JOIN e ON w.o = e.s
  WHERE w.depth < {most} AND NOT list_contains(w.trail, e.s || chr(1) || e.o))
SELECT chain, depth FROM walk WHERE depth >= {least} AND {last}"""


_ENDS = ("s IN (SELECT uid FROM nodes WHERE label = 'Function' AND starts_with(name, 'adc_arm'))", "o IN (SELECT uid FROM nodes WHERE label = 'Function' AND name = 'log_emit')")
_PATHS = _walk("CALLS", 1, 10, "s IN (SELECT uid FROM nodes WHERE label = 'Function' AND starts_with(name, 'adc_arm'))", "o IN (SELECT uid FROM nodes WHERE label = 'Function' AND name = 'log_emit')")
SQL = {
    "q01_node_inventory": f"{WITH} SELECT label AS labels, count(*) AS count FROM nodes GROUP BY 1",
    "q02_edge_inventory": f"{WITH} SELECT type AS relationship, count(*) AS count FROM edges GROUP BY 1",
    "q03_documents_containing": f"{WITH} SELECT file AS path, name AS title FROM nodes WHERE label = 'Document' AND (contains(lower(file), 'beacon') OR contains(lower(name), 'beacon'))",
    "q04_driver_functions": f"{WITH} SELECT name, file, kind FROM nodes WHERE label = 'Function' AND contains(lower(file), 'drivers')",
    "q05_peripherals": f"{WITH} SELECT json_extract_string(metadata, '$.compatible') AS compatible, file AS source_file FROM nodes WHERE label = 'HardwarePeripheral' AND contains(lower(json_extract_string(metadata, '$.compatible')), 'uart')",
    "q06_boards": f"{WITH} SELECT uid AS id, name, file AS path FROM nodes WHERE label = 'Board' AND (contains(lower(uid), 'nrf') OR contains(lower(name), 'nrf'))",
    "q07_board_support": f"{WITH} " + _PAIR.format(cols="a.uid AS board_id, a.name AS board_name, b.name AS peripheral", a="Board", b="HardwarePeripheral", t="SUPPORTS"),
    "q08_function_usage": f"{WITH} " + _PAIR.format(cols="a.name AS function, a.file AS file, b.name AS peripheral", a="Function", b="HardwarePeripheral", t="USES"),
    "q09_document_descriptions": f"{WITH} " + _PAIR.format(cols="a.file AS document, b.name AS function, b.file AS file", a="Document", b="Function", t="DESCRIBES") + " AND contains(lower(b.name), 'printk')",
    "q10_call_graph": f"{WITH} " + _PAIR.format(cols="a.name AS caller, a.file AS caller_file, b.name AS callee, b.file AS callee_file", a="Function", b="Function", t="CALLS"),
    "t1_uart_functions": f"{WITH} SELECT name, file, kind FROM nodes WHERE label = 'Function' AND contains(name, 'uart')",
    "t2_edges_at_uart": f"{WITH}, f AS (SELECT uid FROM nodes WHERE label = 'Function' AND contains(name, 'uart')) SELECT type AS rel_type, count(*) AS count FROM (SELECT type, s AS uid FROM edges UNION ALL SELECT type, o FROM edges WHERE s <> o) WHERE uid IN (SELECT uid FROM f) GROUP BY 1",
    "t3_documents": f"{WITH} SELECT file AS path, description FROM nodes WHERE label = 'Document' ORDER BY path, description NULLS FIRST LIMIT 10",
    "t4_requirements": f"{WITH} SELECT description AS text, file AS source, uid FROM nodes WHERE label = 'Requirement' ORDER BY uid LIMIT 10",
    "t5_and_or_filter": f"{WITH} SELECT uid AS function_uid, name AS function_name, file, line_start, kind FROM nodes WHERE label = 'Function' AND (contains(name, 'uart') OR contains(file, 'uart')) AND (contains(name, 'init') OR contains(name, 'reset') OR contains(name, 'poll'))",
    "t6_call_paths": _PATHS,
    "t6_shortest": _PATHS + " ORDER BY depth, chain LIMIT 5",
    "t7_include_cycles": _walk("INCLUDES", 2, 5, "true", "s = o"),
    "t7_call_cycles": _walk("CALLS", 2, 5, "true", "s = o"),
    "d1_node_to_binding": f"{WITH} " + _PAIR.format(cols="a.name AS node, b.name AS binding", a="DTNode", b="DTBinding", t="COMPATIBLE_WITH") + " AND starts_with(a.name, 'uart')",
    "d2_unwound_labels": f"{WITH} SELECT label, count(*) AS count FROM nodes GROUP BY 1",
    "r1_converging": f"{WITH} SELECT a.o AS option, files, dependents FROM (SELECT o, count(*) AS files FROM edges WHERE type = 'SETS' GROUP BY 1) a JOIN (SELECT o, count(*) AS dependents FROM edges WHERE type = 'DEPENDS_ON' GROUP BY 1) b USING (o)",
    "r2_two_hops": f"{WITH} SELECT DISTINCT n.uid AS document, a.o AS mid, b.o AS callee FROM nodes n JOIN edges a ON a.s = n.uid AND a.type = 'REFERENCES' JOIN edges b ON b.s = a.o AND b.type = 'CALLS' WHERE n.label = 'Document' AND contains(lower(n.name), 'e')",
    "g03_callers": f"{WITH} SELECT DISTINCT e.s AS caller, e.o AS callee FROM edges e JOIN nodes n ON n.uid = e.o WHERE e.type = 'CALLS' AND n.label = 'Function' AND contains(n.name, 'flush')",
    "g06_subtree": f"""{WITH}, e AS (SELECT DISTINCT s, o FROM edges WHERE type = 'CONTAINS'), r(uid, depth) AS (
  SELECT uid, 0 FROM nodes WHERE label = 'Folder' AND regexp_matches(file, '^[^/]+/[^/]+$') UNION SELECT e.o, r.depth + 1 FROM r JOIN e ON r.uid = e.s WHERE r.depth < 8)
SELECT uid, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1""",
    "a01_best_entities": f"{WITH} SELECT uid, kind, entity_id FROM (SELECT DISTINCT ON (entity_id) * FROM ents WHERE uid IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY entity_type, lower(name), CASE WHEN entity_type IN ('KconfigOption', 'DTBinding') THEN '' ELSE source_file END ORDER BY {_PRIO} DESC, entity_id) = 1",
    "a02_last_relations": f"{WITH} SELECT relation_id, subject, predicate, object, source_file FROM rels QUALIFY row_number() OVER (PARTITION BY subject, predicate, object, source_file ORDER BY ingested_at DESC, relation_id DESC) = 1",
    "a03_surest_relations": f"{WITH} SELECT relation_id, confidence FROM rels QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY confidence DESC, relation_id) = 1",
    "a04_degree": f"{WITH} SELECT uid, count(*) AS degree FROM (SELECT s AS uid FROM edges UNION ALL SELECT o FROM edges) GROUP BY 1",
    "a05_isolated": f"{WITH} SELECT label, count(*) AS isolated FROM nodes WHERE label <> 'Folder' AND uid NOT IN (SELECT s FROM edges UNION SELECT o FROM edges) GROUP BY 1",
    "a06_type_distribution": f"{WITH} SELECT entity_type, kind, count(*) AS count FROM ents WHERE uid IS NOT NULL GROUP BY 1, 2",
    "a08_completeness": f"{WITH}, f AS (SELECT DISTINCT source_file FROM source_files), n AS (SELECT DISTINCT file FROM nodes WHERE label = 'SourceFile') SELECT count(*) AS files, count(n.file) AS nodes, count(*) = count(n.file) AS complete FROM f LEFT JOIN n ON f.source_file = n.file",
    "a09_label_sets": f"{WITH} SELECT type, count(*) AS count, array_to_string(list_sort(list(DISTINCT a.label)), ',') AS start_labels, array_to_string(list_sort(list(DISTINCT b.label)), ',') AS end_labels FROM edges e JOIN nodes a ON e.s = a.uid JOIN nodes b ON e.o = b.uid GROUP BY 1",
    "a10_schema_nodes": f"{WITH}, q(label, required) AS (VALUES {_REQUIRED}) SELECT n.label, count(*) AS count, CAST(coalesce(any_value(q.required), 1) AS INTEGER) AS required FROM nodes n LEFT JOIN q ON q.label = n.label GROUP BY 1",
    "a11_confidence_histogram": f"{WITH} SELECT count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.9) AS medium, count(*) FILTER (confidence >= 0.4 AND confidence < 0.6) AS low FROM rels",
    "a12_cross_links": f"{WITH} SELECT count(*) FILTER (type IN ({_CROSS})) AS cross_links FROM edges",
    "a15_totals": f"{WITH} SELECT 'nodes' AS what, count(*) AS total FROM nodes UNION ALL SELECT 'relationships', count(*) FROM edges",
    "a16_distinct_labels": f"{WITH} SELECT (SELECT count(DISTINCT label) FROM nodes) AS labels, (SELECT count(DISTINCT type) FROM edges) AS types, (SELECT count(DISTINCT label) FROM nodes) < 5 AS few_labels, (SELECT count(DISTINCT type) FROM edges) < 8 AS few_types",
    "a18_collect": f"{WITH} SELECT s AS start, array_to_string(list_sort(list(DISTINCT split_part(o, '|', -1))), ',') AS needs FROM edges WHERE type = 'DEPENDS_ON' GROUP BY 1",
    "a19_merged_edges": f"{WITH} SELECT type, s, o, confidence, line FROM edges",
    "o03_top_central": f"{WITH} SELECT uid, count(*) AS degree FROM (SELECT s AS uid FROM edges UNION ALL SELECT o FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "j08_stub_options": f"{WITH} SELECT DISTINCT object AS uid, split_part(object, '|', -1) AS name FROM rels WHERE object LIKE 'KconfigOption|%' AND object NOT IN (SELECT uid FROM ents WHERE uid IS NOT NULL)",
    "j11_skipped_ends": f"{WITH} SELECT type, count(*) AS skipped FROM edges WHERE s NOT IN (SELECT uid FROM nodes) OR o NOT IN (SELECT uid FROM nodes) GROUP BY 1",
    "j12_has_chunk": f"{WITH} SELECT DISTINCT 'HAS_CHUNK' AS type, 'SourceFile|' || source_file AS s, uid AS o FROM source_chunks WHERE 'SourceFile|' || source_file IN (SELECT uid FROM nodes WHERE label = 'SourceFile')",
    "proj_node_rows": f"{WITH} SELECT entity_type AS label, count(*) AS n, CAST(sum(length(coalesce(nullif(source_text, ''), nullif(description, ''), name))) AS BIGINT) AS text_chars FROM (SELECT DISTINCT ON (entity_id) * FROM ents WHERE uid IS NOT NULL) WHERE entity_type <> 'SourceChunk' GROUP BY 1",
    "v09_route": f"{WITH} SELECT CASE WHEN confidence >= 0.8 THEN 'auto' WHEN confidence >= 0.5 THEN 'review' ELSE 'reject' END AS route, confidence < 0.6 AS flagged, count(*) AS n FROM rels GROUP BY 1, 2",
    "v09_versions": f"{WITH} SELECT entity_id, uid, ingested_at AS valid_from, least(deleted_at, lead(ingested_at) OVER (PARTITION BY uid ORDER BY ingested_at)) AS valid_to FROM (SELECT DISTINCT ON (entity_id) * FROM ents WHERE uid IS NOT NULL)",
    "sweep_stubs": f"{WITH} SELECT DISTINCT name AS entity_name, entity_type, source_file, line_start AS line_number, 'referred to, never declared' AS reason FROM ents WHERE entity_type = 'KconfigOption' AND kind = 'stub'",
    "sweep_unsure": f"{WITH} SELECT relation_id, confidence FROM rels WHERE confidence < 0.6",
    "sweep_degree_zero": f"{WITH} SELECT entity_type, count(*) AS n FROM ents WHERE uid IS NOT NULL AND name NOT IN (SELECT split_part(subject, '|', -1) FROM rels UNION SELECT split_part(object, '|', -1) FROM rels) GROUP BY 1",
    "sweep_long_uncommented": f"""{WITH} SELECT DISTINCT entity_id, name FROM ents WHERE entity_type = 'Function' AND kind = 'definition' AND length(substr(source_text, 1, 8000)) - length(replace(substr(source_text, 1, 8000), chr(10), '')) > 100
AND NOT regexp_matches(substr(source_text, 1, 8000), '(?m)^\\s*(?://|/\\*|\\*|#)')""",
    "sweep_uncommented_20": f"""{WITH} SELECT DISTINCT entity_id, name FROM ents WHERE entity_type = 'Function' AND kind = 'definition' AND length(substr(source_text, 1, 8000)) - length(replace(substr(source_text, 1, 8000), chr(10), '')) > 20
AND NOT regexp_matches(substr(source_text, 1, 8000), '(?m)^\\s*(?://|/\\*|\\*|#)')""",
}


def _ranks(rounds: int) -> str:
    out = f"{WITH}, e AS (SELECT DISTINCT s, o FROM edges WHERE type = 'CALLS'), d AS (SELECT s, count(*) AS outs FROM e GROUP BY 1), r0 AS (SELECT DISTINCT uid, CAST(1.0 AS DOUBLE) AS rank FROM (SELECT s AS uid FROM e UNION ALL SELECT o FROM e))"
    for i in range(rounds):
        out += f", g{i} AS (SELECT e.o AS uid, sum(r.rank / d.outs) AS given FROM e JOIN d USING (s) JOIN r{i} r ON r.uid = e.s GROUP BY 1), r{i + 1} AS (SELECT r.uid, CAST(1 AS DOUBLE) - CAST(0.85 AS DOUBLE) + CAST(0.85 AS DOUBLE) * (coalesce(given, 0) + (SELECT coalesce(sum(x.rank), 0) FROM r{i} x WHERE x.uid NOT IN (SELECT s FROM d)) / (SELECT count(*) FROM r{i})) AS rank FROM r{i} r LEFT JOIN g{i} USING (uid))"
    return f"{out} SELECT uid, round(rank, 10) AS rank FROM r{rounds}"


def _communities(rounds: int) -> str:
    out = f"""{WITH}, x AS (SELECT DISTINCT s, o FROM edges WHERE type IN ('DEPENDS_ON', 'SELECTS')), e AS (SELECT s, o FROM x WHERE s <> o UNION SELECT o, s FROM x WHERE s <> o),
l0 AS (SELECT uid, uid AS community FROM nodes WHERE label = 'KconfigOption' UNION SELECT o, o FROM x)"""
    for i in range(rounds):
        out += f""", v{i} AS (SELECT e.s AS uid, l.community, count(*) AS n FROM e JOIN l{i} l ON l.uid = e.o GROUP BY 1, 2), b{i} AS (SELECT uid, community AS new FROM v{i} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, community) = 1),
l{i + 1} AS (SELECT l.uid, coalesce(new, community) AS community FROM l{i} l LEFT JOIN b{i} USING (uid))"""
    return f"{out} SELECT uid, community FROM l{rounds}"


SQL |= {"g05_pagerank": _ranks(4), "g05_communities": _communities(3)}


def _event_walk(least: int, most: int, first: str, last: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events) WHERE o IS NOT NULL),
walk(s, o, chain, trail, depth) AS (SELECT s, o, s || ' > ' || o, [s || chr(1) || o], 1 FROM e WHERE {first}
  UNION ALL SELECT w.s, e.o, w.chain || ' > ' || e.o, list_append(w.trail, e.s || chr(1) || e.o), w.depth + 1 FROM walk w JOIN e ON w.o = e.s WHERE w.depth < {most} AND NOT list_contains(w.trail, e.s || chr(1) || e.o))
SELECT chain, depth FROM walk WHERE depth >= {least} AND {last}"""


SQL |= {"g01_event_paths": _event_walk(1, 3, "s = 'signup'", "o = 'purchase'"), "g02_event_cycles": _event_walk(2, 3, "true", "s = o")}
SQL |= {"g01_call_trails": _walk("CALLS", 1, 10, *_ENDS), "g01_shortest_trails": _walk("CALLS", 1, 10, *_ENDS) + " ORDER BY depth, chain LIMIT 5"}
SQL |= {"g02_include_cycles": _walk("INCLUDES", 2, 5, "true", "s = o"), "g02_call_cycles": _walk("CALLS", 2, 5, "true", "s = o")}
