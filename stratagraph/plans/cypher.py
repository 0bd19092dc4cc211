"""Read-only graph queries as text: the clauses MATCH, WHERE, WITH, UNWIND, RETURN, ORDER BY, SKIP and LIMIT as DataFrame plans.

``Cypher(graph).run(text)`` parses the text into clauses and builds one plan. A variable is a column: a node or edge is a
struct of its properties, a path a struct of its chain of uids and its depth. Labels and inline properties are filters
on the scan of nodes, types are filters on the scan of edges, so Catalyst sees plain filters and equi-joins. Patterns
of variable length are trails (edges do not repeat) and need an upper bound. Anything that would write is no clause here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut
from ..operators.graph import PropertyGraph

_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)"
    r"|(?P<op><>|<=|>=|\.\.|->|<-|=~|[-+*/%=<>()\[\]{},.:|;])",
    re.S,
)
_CLAUSES = ("MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND", "ORDER", "LIMIT", "SKIP")
_AGGREGATES = ("count", "collect", "sum", "avg", "min", "max")


class CypherError(ValueError):
    pass


@dataclass
class Node:
    var: str | None
    label: str | None
    props: list = field(default_factory=list)


@dataclass
class Rel:
    var: str | None
    types: list[str]
    out: bool
    into: bool
    least: int | None = None
    most: int | None = None


def tokens(text: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise CypherError(f"cannot read {text[pos : pos + 20]!r}")
        pos = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0].strip("`") if m.lastgroup == "name" else m[0]))
    return [*out, ("end", "")]


class Reader:
    """Recursive descent over the tokens; expressions become nested tuples."""

    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self, *words: str) -> bool:
        kind, w = self.t[self.i]
        return kind != "str" and w.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word} before {self.t[self.i][1]!r}")

    def name(self) -> str:
        kind, w = self.t[self.i]
        if kind != "name":
            raise CypherError(f"expected a name before {w!r}")
        self.i += 1
        return w

    # -- patterns

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.t[self.i][0] == "name" else None
        label = self.name() if self.take(":") else None
        props = []
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                props.append((key, self.expr()))
                self.take(",")
        self.need(")")
        return Node(var, label, props)

    def rel(self) -> Rel:
        into = self.take("<-")
        if not into:
            self.need("-")
        r = Rel(None, [], False, into)
        if self.take("["):
            if self.t[self.i][0] == "name":
                r.var = self.name()
            if self.take(":"):
                r.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    r.types.append(self.name())
            if self.take("*"):
                r.least, r.most = 1, None
                if self.t[self.i][0] == "num":
                    r.least = r.most = int(self.t[self.i][1])
                    self.i += 1
                if self.take(".."):
                    r.most = None
                    if self.t[self.i][0] == "num":
                        r.most = int(self.t[self.i][1])
                        self.i += 1
                if r.most is None:
                    raise CypherError("a pattern of variable length needs an upper bound")
            self.need("]")
        r.out = self.take("->")
        if not r.out:
            self.need("-")
        return r

    def pattern(self):
        path = None
        if self.t[self.i][0] == "name" and self.t[self.i + 1][1] == "=":
            path = self.name()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.peek("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return path, nodes, rels

    # -- expressions

    def expr(self):
        left = self.conj()
        while self.take("OR"):
            left = ("or", left, self.conj())
        return left

    def conj(self):
        left = self.neg()
        while self.take("AND"):
            left = ("and", left, self.neg())
        return left

    def neg(self):
        return ("not", self.neg()) if self.take("NOT") else self.compare()

    def compare(self):
        left = self.add()
        if self.peek("=", "<>", "<", ">", "<=", ">=", "=~"):
            op = self.t[self.i][1]
            self.i += 1
            return (op, left, self.add())
        if self.take("CONTAINS"):
            return ("contains", left, self.add())
        if self.take("STARTS"):
            self.need("WITH")
            return ("starts", left, self.add())
        if self.take("ENDS"):
            self.need("WITH")
            return ("ends", left, self.add())
        if self.take("IN"):
            return ("in", left, self.add())
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return ("not", ("null", left)) if no else ("null", left)
        return left

    def add(self):
        left = self.mul()
        while self.peek("+", "-"):
            op = self.t[self.i][1]
            self.i += 1
            left = (op, left, self.mul())
        return left

    def mul(self):
        left = self.unary()
        while self.peek("*", "/", "%"):
            op = self.t[self.i][1]
            self.i += 1
            left = (op, left, self.unary())
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        e = self.atom()
        while True:
            if self.take("."):
                e = ("prop", e, self.name())
            elif self.take("["):
                e = ("index", e, self.expr())
                self.need("]")
            else:
                return e

    def atom(self):
        kind, w = self.t[self.i]
        self.i += 1
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", w[1:-1]))
        if kind == "num":
            return ("lit", float(w) if "." in w else int(w))
        if kind == "param":
            return ("param", w[1:])
        if w == "(":
            e = self.expr()
            self.need(")")
            return e
        if w == "[":
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if kind == "name":
            if w.upper() in ("TRUE", "FALSE"):
                return ("lit", w.upper() == "TRUE")
            if w.upper() == "NULL":
                return ("lit", None)
            if self.take("("):
                if self.take("*"):
                    self.need(")")
                    return ("call", w.lower(), False, [])
                distinct, args = self.take("DISTINCT"), []
                while not self.take(")"):
                    args.append(self.expr())
                    self.take(",")
                return ("call", w.lower(), distinct, args)
            return ("var", w)
        raise CypherError(f"unexpected {w!r}")

    def items(self):
        out = []
        while True:
            start = self.i
            e = self.expr()
            shown = "".join(w if k != "name" or not j or self.t[start + j - 1][0] != "name" else " " + w for j, (k, w) in enumerate(self.t[start : self.i]))
            out.append((self.name() if self.take("AS") else e[1] if e[0] == "var" else shown, e))
            if not self.take(","):
                return out


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple) and ((e[0] == "call" and e[1] in _AGGREGATES) or any(_has_aggregate(x) if isinstance(x, tuple) else any(map(_has_aggregate, x)) if isinstance(x, list) else False for x in e[1:]))


class Cypher:
    def __init__(self, graph: PropertyGraph, **params):
        self.g, self.params = graph, params
        cols = graph.nodes.columns
        self.props = [c for c in cols]
        if "path" not in cols and "file" in cols:
            self.props.append("path")
        if "title" not in cols and "name" in cols:
            self.props.append("title")

    def run(self, text: str) -> DataFrame:
        r = Reader(text)
        self.df: DataFrame | None = None
        self.kinds: dict[str, str] = {}
        self.fresh = 0
        while r.t[r.i][0] != "end":
            if r.take(";"):
                continue
            if r.take("OPTIONAL"):
                raise CypherError("OPTIONAL MATCH is not supported")
            if r.take("MATCH"):
                while True:
                    self._match(*r.pattern())
                    if not r.take(","):
                        break
                if r.take("WHERE"):
                    self.df = self.df.where(self._col(r.expr()))
            elif r.take("UNWIND"):
                e = r.expr()
                r.need("AS")
                self._unwind(e, r.name())
            elif r.take("WITH"):
                self._project(r.take("DISTINCT"), r.items())
                self._tail(r)
                if r.take("WHERE"):
                    self.df = self.df.where(self._col(r.expr()))
            elif r.take("RETURN"):
                self._project(r.take("DISTINCT"), r.items(), last=True)
                self._tail(r)
            else:
                raise CypherError(f"{r.t[r.i][1]!r} is no clause of a read-only query")
        if self.df is None:
            raise CypherError("nothing to run")
        return self.df

    # -- patterns

    def _scan(self, n: Node) -> DataFrame:
        nodes = self.g.nodes
        if n.label:
            nodes = nodes.where(F.col("label") == n.label)
        given = {"path": F.col("file") if "file" in nodes.columns else None, "title": F.col("name") if "name" in nodes.columns else None}
        nodes = nodes.select(*(F.col(c) if c in nodes.columns else given[c].alias(c) for c in self.props))
        for key, e in n.props:
            nodes = nodes.where(F.col(key) == self._col(e)) if key in self.props else nodes.where(F.lit(False))
        return nodes.select(F.struct(*self.props).alias(n.var))

    def _name(self, given: str | None) -> str:
        if given:
            return given
        self.fresh += 1
        return f"_v{self.fresh}"

    def _add_node(self, n: Node, on: Column | None) -> None:
        """Joins the scan of a node, or checks a node that is bound already."""
        if n.var in self.kinds:
            if on is not None:
                self.df = self.df.where(on)
            if n.label:
                self.df = self.df.where(F.col(n.var)["label"] == n.label)
            return
        scan = self._scan(n)
        self.kinds[n.var] = "node"
        if self.df is None:
            self.df = scan
        elif on is None:
            raise CypherError("patterns of one query must share a variable")
        else:
            self.df = self.df.join(scan, on)

    def _match(self, path: str | None, nodes: list[Node], rels: list[Rel]) -> None:
        for n in nodes:
            n.var = self._name(n.var)
        for r in rels:
            r.var = self._name(r.var)
        if len(rels) == 1 and rels[0].most is not None:
            self._match_long(path, nodes, rels[0])
            return
        first = next((i for i, n in enumerate(nodes) if n.var in self.kinds), 0)
        self._add_node(nodes[first], None)
        steps = [(i, False) for i in range(first, len(rels))] + [(i - 1, True) for i in range(first, 0, -1)]
        for i, backward in steps:
            r = rels[i]
            if r.most is not None:
                raise CypherError("a pattern of variable length must stand alone")
            here, there = (nodes[i + 1], nodes[i]) if backward else (nodes[i], nodes[i + 1])
            forward = r.out and not r.into
            edges = self.g.edge(*r.types)
            shape = F.struct(*edges.columns)
            a, b = ("start", "end") if (forward != backward) else ("end", "start")
            e = edges.select(shape.alias(r.var), F.col(a).alias("_from"), F.col(b).alias("_to"))
            if not r.out and not r.into:  # either way; a loop once
                back = edges.where("start <> end").select(shape.alias(r.var), F.col("end").alias("_from"), F.col("start").alias("_to"))
                e = edges.select(shape.alias(r.var), F.col("start").alias("_from"), F.col("end").alias("_to")).unionByName(back)
            self.df = self.df.join(e, F.col(here.var)["uid"] == F.col("_from"))
            self.kinds[r.var] = "rel"
            self._add_node(there, F.col(there.var)["uid"] == F.col("_to"))
            self.df = self.df.drop("_from", "_to")
        if path:
            self.kinds[path] = "path"
            chain = F.array(*(F.col(n.var)["uid"] for n in nodes))
            self.df = self.df.withColumn(path, F.struct(chain.alias("chain"), F.lit(len(rels)).alias("depth")))

    def _match_long(self, path: str | None, nodes: list[Node], r: Rel) -> None:
        if self.df is not None:
            raise CypherError("a pattern of variable length must come first")
        if not (r.out ^ r.into):
            raise CypherError("a pattern of variable length needs a direction")
        a, b = nodes if r.out else nodes[::-1]
        ids = lambda n: self._scan(n).select(F.col(n.var)["uid"].alias("uid"))
        least = 1 if r.least is None else r.least
        if a.var == b.var:
            found = self.g.cycles(r.types, least, r.most).select(F.col("chain")[0].alias("_a"), F.col("chain")[0].alias("_b"), "chain", "depth")
        else:
            found = self.g.paths(r.types, ids(a), ids(b), r.most, least).select(F.col("source").alias("_a"), F.col("target").alias("_b"), "chain", "depth")
        p = path or self._name(None)
        self.df = found.select("_a", "_b", F.struct("chain", "depth").alias(p))
        self.kinds[p] = "path"
        for n, key in ((a, "_a"), (b, "_b")):
            if n.var not in self.kinds:
                self.df = self.df.join(self._scan(n), F.col(key) == F.col(n.var)["uid"])
                self.kinds[n.var] = "node"
        self.df = self.df.drop("_a", "_b")

    # -- projections

    def _nodes_of(self, path: str) -> str:
        """Adds the nodes of a path as an array of structs."""
        name = f"_nodes_{path}"
        if name not in self.df.columns:
            keyed = cut(self.df.withColumn("_id", F.monotonically_increasing_id()))  # written, so that the ids are the same in both uses
            uids = keyed.select("_id", F.posexplode(F.col(path)["chain"]).alias("_at", "_uid"))
            n = Node("_n", None)
            got = uids.join(self._scan(n), F.col("_uid") == F.col("_n")["uid"]).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_n"))).alias("_l"))  # a path's nodes
            self.df = keyed.join(got, "_id").withColumn(name, F.transform("_l", lambda x: x["_n"])).drop("_id", "_l")
        return name

    def _prepare(self, e) -> None:
        """Adds what an expression needs beside its columns: the nodes of paths."""
        if isinstance(e, tuple):
            if e[0] == "call" and e[1] == "nodes":
                self._nodes_of(e[3][0][1])
            for x in e[1:]:
                for y in x if isinstance(x, list) else [x]:
                    self._prepare(y)

    def _unwind(self, e, name: str) -> None:
        self._prepare(e)
        if self.df is None:
            self.df = self.g.nodes.sparkSession.range(1).drop("id")
        kind = "node" if e[0] == "call" and e[1] == "nodes" else "value"
        self.df = self.df.withColumn(name, F.explode(self._col(e)))
        self.kinds[name] = kind

    def _project(self, distinct: bool, items, last: bool = False) -> None:
        for _, e in items:
            self._prepare(e)
        kinds = {n: self.kinds.get(e[1], "value") if e[0] == "var" else "value" for n, e in items}
        if any(_has_aggregate(e) for _, e in items):
            keys = [self._col(e).alias(n) for n, e in items if not _has_aggregate(e)]
            sums = [self._col(e).alias(n) for n, e in items if _has_aggregate(e)]
            self.df = (self.df.groupBy(*keys) if keys else self.df).agg(*sums).select(*(F.col(f"`{n}`") for n, _ in items))
        else:
            hidden = [] if last else [c for c in self.df.columns if c.startswith("_nodes_") and c.removeprefix("_nodes_") in {n for n, _ in items}]
            self.before = (self.df, dict(self.kinds))
            self.df = self.df.select(*(self._col(e).alias(n) for n, e in items), *hidden)
        self.shown = {repr(e): n for n, e in items}
        self.kinds = kinds
        if distinct:
            self.df = self.df.distinct()

    def _tail(self, r: Reader) -> None:
        if r.take("ORDER"):
            r.need("BY")
            keys = []
            while True:
                e = r.expr()
                name = self.shown.get(repr(e))
                c = F.col(f"`{name}`") if name else self._col(e)
                keys.append(c.desc() if r.take("DESC", "DESCENDING") else (r.take("ASC", "ASCENDING"), c.asc())[1])
                if not r.take(","):
                    break
            self.df = self.df.orderBy(*keys)
        if r.take("SKIP"):
            self.df = self.df.offset(int(r.atom()[1]))
        if r.take("LIMIT"):
            self.df = self.df.limit(int(r.atom()[1]))

    # -- expressions

    def _col(self, e) -> Column:
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "param":
            return F.lit(self.params[e[1]])
        if op == "list":
            return F.array(*(self._col(x) for x in e[1]))
        if op == "var":
            if e[1] not in self.df.columns:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if op == "prop":
            base = e[1]
            if base[0] == "var" and self.kinds.get(base[1]) == "node" and e[2] not in self.props:
                return F.get_json_object(F.col(base[1])["metadata"], f"$.{e[2]}") if "metadata" in self.props else F.lit(None).cast("string")
            return self._col(base)[e[2]]
        if op == "index":
            return F.get(self._col(e[1]), self._col(e[2]))
        if op in ("and", "or"):
            a, b = self._col(e[1]), self._col(e[2])
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self._col(e[1])
        if op == "null":
            return self._col(e[1]).isNull()
        if op == "neg":
            return -self._col(e[1])
        if op == "in":
            return F.array_contains(self._col(e[2]), self._col(e[1]))
        if op in ("contains", "starts", "ends"):
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[op](self._col(e[1]), self._col(e[2]))
        if op == "call":
            return self._call(e[1], e[2], e[3])
        a, b = self._col(e[1]), self._col(e[2])
        plain = {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, ">": a.__gt__, "<=": a.__le__, ">=": a.__ge__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__, "%": a.__mod__}
        if op == "+":
            return F.concat(a, b) if any(x[0] == "lit" and isinstance(x[1], str) for x in e[1:]) else a + b
        if op == "=~":
            return F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        return plain[op](b)

    def _call(self, f: str, distinct: bool, args: list) -> Column:
        if f == "count":
            return F.count("*") if not args else F.countDistinct(self._col(args[0])) if distinct else F.count(self._col(args[0]))
        if f in ("nodes", "relationships", "length", "size", "labels", "type", "id") and args and args[0][0] == "var":
            kind, c = self.kinds.get(args[0][1]), self._col(args[0])
            if kind == "path":
                if f == "nodes":
                    return F.col(f"_nodes_{args[0][1]}")
                if f == "relationships":
                    chain = c["chain"]
                    return F.zip_with(F.slice(chain, F.lit(1), F.size(chain) - 1), F.slice(chain, F.lit(2), F.size(chain) - 1), lambda x, y: F.struct(x.alias("start"), y.alias("end")))
                return c["depth"]
            if f == "labels":
                return F.array(c["label"])
            if f == "type":
                return c["type"]
            if f == "id":
                return c["uid"]
        x = [self._col(a) for a in args]
        simple = {
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": lambda c: F.size(c), "length": F.length, "coalesce": F.coalesce, "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.try_cast("long"), "tofloat": lambda c: c.try_cast("double"),
            "split": lambda c, s: F.split(c, F.concat(F.lit("\\Q"), s, F.lit("\\E"))), "head": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.element_at(c, -1), "abs": F.abs, "round": F.round, "substring": lambda c, a, n=None: F.substring(c, a + 1, n if n is not None else F.lit(2**30)),
            "collect": lambda c: F.collect_set(c) if distinct else F.collect_list(c), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
        }
        if f not in simple:
            raise CypherError(f"unknown function {f}")
        return simple[f](*x)
