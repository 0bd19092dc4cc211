"""The property graph as two tables, and pattern queries over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut


@dataclass
class PropertyGraph:
    """nodes (uid, label, name, file, kind, ...), edges (type, start, end, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def node(self, label: str | None = None, where: Column | None = None, prefix: str = "") -> DataFrame:
        """Nodes of a label, their columns with a prefix."""
        out = self.nodes if label is None else self.nodes.where(F.col("label") == label)
        out = out if where is None else out.where(where)
        return out.select(*(F.col(c).alias(prefix + c) for c in out.columns)) if prefix else out

    def edge(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def hop(self, start: DataFrame, types: list[str], end: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
        """(a)-[:types]->(b); start and end come from :meth:`node` with prefixes a and b."""
        e = self.edge(*types).select("type", "start", "end")
        return start.join(e, F.col(a + "uid") == F.col("start")).join(end, F.col("end") == F.col(b + "uid")).drop("start", "end")

    def touching(self, nodes: DataFrame) -> DataFrame:
        """(n)-[r]-(): one row per edge and end that is in nodes, a loop once."""
        chosen = nodes.select("uid").distinct()
        out = self.edges.select("type", "start", "end", F.col("start").alias("uid"))
        back = self.edges.where("start <> end").select("type", "start", "end", F.col("end").alias("uid"))
        return out.unionByName(back).join(chosen, "uid", "left_semi")

    def reachable(self, types: list[str], seeds: DataFrame, depth: int, backward: bool = False) -> DataFrame:
        """(uid, depth): nodes within so many steps of the seeds, each with its least depth. One join a step, frontiers only."""
        return self._reach(cut(self.edge(*types).select("start", "end").distinct()), seeds, depth, backward)

    @staticmethod
    def _reach(e: DataFrame, seeds: DataFrame, depth: int, backward: bool) -> DataFrame:
        """The same over distinct (start, end) that are cut already: every step reads them."""
        e = e.select(F.col("end").alias("a"), F.col("start").alias("b")) if backward else e.select(F.col("start").alias("a"), F.col("end").alias("b"))
        seen = cut(seeds.select("uid").distinct().withColumn("depth", F.lit(0)))
        front = seen
        for d in range(1, depth + 1):
            step = front.join(e, F.col("uid") == F.col("a")).select(F.col("b").alias("uid")).distinct()
            front = cut(step.join(seen.select("uid"), "uid", "left_anti").withColumn("depth", F.lit(d)))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        return seen

    def paths(self, types: list[str], sources: DataFrame, targets: DataFrame, most: int, least: int = 1) -> DataFrame:
        """(source, target, chain, depth): trails of least..most edges; no edge twice, nodes may return.

        Pruned from both sides: a trail is only carried on over nodes from which a target can still be reached in time.
        """
        e = cut(self.edge(*types).select("start", "end").distinct())
        ends = cut(targets.select("uid").distinct())  # every step asks for them
        left = self._reach(e, ends, most, backward=True).select(F.col("uid").alias("end"), F.col("depth").alias("left"))
        e = cut(e.withColumn("eid", F.struct("start", "end")).join(left, "end"))
        goal = ends.select(F.col("uid").alias("goal"))
        front = sources.select("uid").distinct().select(F.col("uid").alias("source"), F.col("uid").alias("at"), F.array("uid").alias("chain"), F.array().cast("array<struct<start:string,end:string>>").alias("trail"))
        found = []
        for d in range(1, most + 1):
            step = front.join(e, F.col("at") == F.col("start")).where((F.col("left") <= most - d) & ~F.array_contains("trail", F.col("eid")))
            front = cut(step.select("source", F.col("end").alias("at"), F.array_append("chain", F.col("end")).alias("chain"), F.array_append("trail", F.col("eid")).alias("trail")))
            if d >= least:
                found.append(front.join(goal, F.col("at") == F.col("goal"), "left_semi").select("source", F.col("at").alias("target"), "chain", F.lit(d).alias("depth")))
            if front.isEmpty():
                break
        if not found:
            return front.select("source", F.col("at").alias("target"), "chain", F.lit(0).alias("depth")).limit(0)
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def cycles(self, types: list[str], least: int = 2, most: int = 5) -> DataFrame:
        """(chain, depth): closed trails, every rotation its own row.

        Only nodes that lie on some cycle start a trail: nodes without both ways in and out are peeled off first.
        """
        e = cut(self.edge(*types).select("start", "end").distinct())
        for _ in range(most):
            n = e.count()
            outs, ins = e.select(F.col("start").alias("uid")).distinct(), e.select(F.col("end").alias("uid")).distinct()
            both = outs.join(ins, "uid", "left_semi")
            e = cut(e.join(both.withColumnRenamed("uid", "start"), "start", "left_semi").join(both.withColumnRenamed("uid", "end"), "end", "left_semi"))
            if e.count() == n:
                break
        e = e.withColumn("eid", F.struct("start", "end"))
        front = e.select(F.col("start").alias("source"), F.col("end").alias("at"), F.array("start", "end").alias("chain"), F.array("eid").alias("trail"))
        found = [front.where("source = at").select("chain", F.lit(1).alias("depth"))] if least <= 1 else []
        for d in range(2, most + 1):
            step = front.join(e, F.col("at") == F.col("start")).where(~F.array_contains("trail", F.col("eid")))
            front = cut(step.select("source", F.col("end").alias("at"), F.array_append("chain", F.col("end")).alias("chain"), F.array_append("trail", F.col("eid")).alias("trail")))
            if d >= least:
                found.append(front.where("source = at").select("chain", F.lit(d).alias("depth")))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def trace_dependency(self, source_uid: str, target_uid: str, max_depth: int, types: tuple[str, ...] = ("CALLS", "INCLUDES", "DEPENDS_ON")) -> DataFrame:
        spark = self.nodes.sparkSession
        one = lambda u: spark.createDataFrame([(u,)], "uid string")
        return self.paths(list(types), one(source_uid), one(target_uid), max_depth).orderBy("depth")

    def callers(self, functions: DataFrame) -> DataFrame:
        """(caller, callee) of every call that reaches one of the functions."""
        return self.edge("CALLS").join(functions.select(F.col("uid").alias("end")).distinct(), "end", "left_semi").select(F.col("start").alias("caller"), F.col("end").alias("callee")).distinct()

    def degree(self) -> DataFrame:
        """(uid, degree): ends of edges at each node, a loop counting twice."""
        return self.edges.select(F.explode(F.array("start", "end")).alias("uid")).groupBy("uid").agg(F.count("*").alias("degree"))

    def communities(self, rounds: int = 5) -> DataFrame:
        """(uid, community) by label propagation: each node takes the most frequent label around it, ties by the least label."""
        e = self.edges.where("start <> end").select("start", "end").distinct()
        e = cut(e.unionByName(e.select(F.col("end").alias("start"), F.col("start").alias("end"))).distinct())
        labels = cut(self.nodes.select("uid", F.col("uid").alias("community")).distinct())
        for _ in range(rounds):
            votes = e.join(labels, F.col("end") == F.col("uid")).groupBy(F.col("start").alias("uid"), "community").agg(F.count("*").alias("n"))
            best = votes.groupBy("uid").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("new"))
            labels = cut(labels.join(best, "uid", "left").select("uid", F.coalesce("new", "community").alias("community")))
        return labels

    def pagerank(self, rounds: int = 10, damping: float = 0.85) -> DataFrame:
        """(uid, rank), the ranks adding up to the number of nodes; what nodes without a way out hold goes to all alike."""
        e = self.edges.select("start", "end").distinct()
        out = e.groupBy("start").agg(F.count("*").alias("outs"))
        e = cut(e.join(out, "start"))
        rank = cut(self.nodes.select("uid").distinct().withColumn("rank", F.lit(1.0)))
        n = max(rank.count(), 1)
        dangling = cut(rank.select("uid").join(out.select(F.col("start").alias("uid")), "uid", "left_anti"))
        for _ in range(rounds):
            given = e.join(rank, F.col("start") == F.col("uid")).groupBy(F.col("end").alias("uid")).agg(F.sum(F.col("rank") / F.col("outs")).alias("given"))
            lost = (rank.join(dangling, "uid", "left_semi").agg(F.sum("rank")).first()[0] or 0.0) / n
            rank = cut(rank.join(given, "uid", "left").select("uid", (F.lit(1 - damping) + damping * (F.coalesce("given", F.lit(0.0)) + F.lit(lost))).alias("rank")))
        return rank
