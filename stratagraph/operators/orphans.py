"""References to records that do not exist.

Keyed state, maintained incrementally over consecutive slices of time:

* ``live``: uid -> how many records with that uid are live at the end of the slice (the parent index),
* ``waiting``: uid, predicate -> references made so far.

A slice brings changes (a record arrives, +1, or is deleted, -1) and references. New references probe the index as it
is at their own moment; a record that arrives resolves the references waiting for its uid, a deletion reopens them,
and the end of each slice gives a snapshot of the references pending then. Slices are calendar months unless their number
is given; a month in which nothing happens would repeat the snapshot before it and is no slice.

The state can be saved and loaded, so a run goes on where the last one ended (:func:`go_on`). Inside a run the state is
carried from slice to slice by running sums over what changes, key by key, so a slice costs what it changes and not the
whole state. A run also says which uids were resolved or reopened by a slice, with the references that wait for them.

A hot uid never lies in one task: the rows of a uid with more than ``HOT_ROWS`` references, a fixed number, are split
into periods of an hour; the net changes of the periods are summed first, and a running sum over them gives the state
carried into each period, so that periods are independent of each other.

Defined results: null or blank endpoints and those starting with ``external:`` are no references; blanks and tabs
around an endpoint are ignored and ``\\`` is read as ``/``; a record without ingested_at, or deleted at or before it,
is never live; a reference without a moment finds nothing live; repeated rows count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import cut, union_all
from ..schema import entity_uid

PERIOD_SECONDS = 3_600
HOT_ROWS = 100_000
BROADCAST_HOT = 100_000  # hot uids; beyond that they are joined by shuffle, with the same rows


def endpoint(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""), "\\", "/")


def references(relations: DataFrame) -> DataFrame:
    """(relation_id, endpoint, uid, predicate, at): one row per endpoint that refers to a record."""
    relations = relations.select("relation_id", "subject", "object", "predicate", F.col("ingested_at").cast("timestamp").alias("ingested_at")).distinct()
    ends = F.explode(F.array(*(F.struct(F.lit(e).alias("endpoint"), endpoint(F.col(e)).alias("uid")) for e in ("subject", "object"))))
    rows = relations.select("relation_id", "predicate", F.col("ingested_at").alias("at"), ends.alias("e"))
    rows = rows.select("relation_id", "e.endpoint", "e.uid", "predicate", "at")
    return rows.where((F.trim("uid") != "") & ~F.col("uid").startswith("external:"))


def changes(entities: list[DataFrame], chunks: DataFrame) -> DataFrame:
    """(uid, at, delta): arrivals and deletions of records. A repeated row adds and takes away once more, which changes no state."""
    spans = [e.select(entity_uid().alias("uid"), F.col("ingested_at").alias("a"), F.col("deleted_at").alias("z")) for e in entities]
    spans.append(chunks.select("uid", F.col("ingested_at").alias("a"), F.lit(None).cast("timestamp_ntz").alias("z")))
    spans = [s.select("uid", F.col("a").cast("timestamp"), F.col("z").cast("timestamp")) for s in spans]
    lives = union_all(spans).where("uid is not null and a is not null and (z is null or z > a)")
    both = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("delta")))
    return lives.select("uid", F.explode(both).alias("c")).select("uid", "c.at", "c.delta").where("at is not null")


@dataclass
class OrphanState:
    live: DataFrame
    waiting: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls(spark.createDataFrame([], "uid string, open long"), spark.createDataFrame([], "uid string, predicate string, refs long"))

    def save(self, folder: str) -> None:
        """Writes the state to a new folder; a folder that has one already is an error, the state being what is read there."""
        self.live.write.parquet(f"{folder}/live")
        self.waiting.write.parquet(f"{folder}/waiting")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> OrphanState:
        return cls(spark.read.parquet(f"{folder}/live"), spark.read.parquet(f"{folder}/waiting"))


def _line(df: DataFrame, kind: int, **given) -> DataFrame:
    kinds = {"uid": "string", "period": "long", "at": "timestamp", "delta": "long", "relation_id": "long", "endpoint": "string", "predicate": "string"}
    cols = {c: (given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in kinds.items()}
    return df.select(*(v.alias(c) for c, v in cols.items()), F.lit(kind).alias("kind"))


def probe(live: DataFrame, moves: DataFrame, refs: DataFrame, period_seconds: int = PERIOD_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The references whose uid has no live record at their moment. ``live`` is the index before the slice."""
    hot = cut(refs.groupBy("uid").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("uid", F.lit(True).alias("hot")))
    if hot.count() <= BROADCAST_HOT:
        hot = F.broadcast(hot)
    period = F.floor(F.unix_timestamp("at") / period_seconds)
    place = lambda df: df.join(hot, "uid", "left").withColumn("period", F.when(F.col("hot"), period).otherwise(F.lit(0)))

    timed = place(refs.where("at is not null"))
    moved = place(moves)
    kept = live.join(hot, "uid", "left")
    # hot uids: the state at the start of every period, from the net changes of the periods before it
    net = union_all([
        moved.where("hot").groupBy("uid", "period").agg(F.sum("delta").alias("net")),
        kept.where("hot").select("uid", F.lit(None).cast("long").alias("period"), F.col("open").alias("net")),
        timed.where("hot").select("uid", "period").distinct().withColumn("net", F.lit(0).cast("long")),
    ]).groupBy("uid", "period").agg(F.sum("net").alias("net"))
    before = Window.partitionBy("uid").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carried = net.withColumn("open", F.sum("net").over(before)).where("open <> 0 and period is not null")

    nothing = F.lit(None)
    line = union_all([
        _line(timed, 1, delta=F.lit(0)),
        _line(moved, 0),
        _line(kept.where("hot is null"), 0, period=F.lit(0), at=nothing, delta=F.col("open")),
        _line(carried, 0, at=nothing, delta=F.col("open")),
    ])
    upto = Window.partitionBy("uid", "period").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = line.withColumn("now", F.sum("delta").over(upto)).where("kind = 1 and now <= 0")
    cols = ["relation_id", "endpoint", "uid", "predicate", "at"]
    return missing.select(*cols).unionByName(refs.where("at is null").select(*cols))


def kind_of(uid: Column) -> Column:
    """The kind of record a uid names."""
    return F.substring_index(uid, "|", 1)


def timeline(state: OrphanState, moves: DataFrame, refs: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(uid, predicate, slice, before, refs, open, turn): references made before a slice and up to its end, whether the uid is live at its
    end, and how that changed (1: resolved, -1: reopened), for the slices in which any of it changes; the given state is slice -1."""
    later = [F.col("at") >= F.lit(lo) for lo, _ in bounds[1:]]
    place = F.coalesce(sum((c.cast("int") for c in later), F.lit(0)), F.lit(0)).alias("slice")
    first = F.lit(-1).alias("slice")
    nets = state.live.select("uid", first, F.col("open").alias("net")).unionByName(moves.select("uid", place, F.col("delta").cast("long").alias("net")))
    nets = nets.groupBy("uid", "slice").agg(F.sum("net").alias("net"))
    of_uid = Window.partitionBy("uid").orderBy("slice")
    nets = nets.withColumn("open", (F.sum("net").over(of_uid.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > 0).cast("int"))
    turns = nets.withColumn("turn", F.col("open") - F.coalesce(F.lag("open").over(of_uid), F.lit(0))).where("turn <> 0").select("uid", "slice", "turn")

    made = state.waiting.select("uid", "predicate", first, "refs").unionByName(refs.select("uid", "predicate", place, F.lit(1).cast("long").alias("refs")))
    made = made.groupBy("uid", "predicate", "slice").agg(F.sum("refs").alias("refs"))
    turned = made.select("uid", "predicate").distinct().join(turns, "uid").withColumn("refs", F.lit(0).cast("long"))
    lines = made.withColumn("turn", F.lit(0)).unionByName(turned).groupBy("uid", "predicate", "slice").agg(F.sum("refs").alias("new"), F.sum("turn").alias("turn"))
    upto = Window.partitionBy("uid", "predicate").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("refs", F.sum("new").over(upto)).withColumn("open", F.sum("turn").over(upto))
    return lines.select("uid", "predicate", "slice", (F.col("refs") - F.col("new")).alias("before"), "refs", "open", "turn")


def pending(lines: DataFrame, n: int) -> DataFrame:
    """(predicate, kind, pending, slice): the references that wait at the end of each of n slices."""
    waits = F.when(F.col("open") > 0, 0).otherwise(F.col("refs"))
    last = Window.partitionBy("uid", "predicate").orderBy("slice")
    moved = lines.withColumn("waits", waits).withColumn("change", F.col("waits") - F.coalesce(F.lag("waits").over(last), F.lit(0)))
    moved = moved.groupBy("predicate", kind_of(F.col("uid")).alias("kind"), F.greatest("slice", F.lit(0)).alias("slice")).agg(F.sum("change").alias("change"))
    every = moved.select("predicate", "kind", "change", F.explode(F.sequence("slice", F.lit(n - 1))).alias("slice"))
    return every.groupBy("predicate", "kind", "slice").agg(F.sum("change").alias("pending")).where("pending > 0").select("predicate", "kind", "pending", "slice")


def transitions(lines: DataFrame) -> DataFrame:
    """(uid, what, refs, slice): uids that a slice resolved or reopened, with the references that had been made before it."""
    turned = lines.where("slice >= 0 and turn <> 0 and before > 0").groupBy("uid", "slice", "turn").agg(F.sum("before").alias("refs"))
    return turned.select("uid", F.when(F.col("turn") > 0, "resolved").otherwise("reopened").alias("what"), "refs", "slice")


def go_on(state: OrphanState, moves: DataFrame, refs: DataFrame, bounds: list[tuple], start: bool = True) -> tuple[OrphanState, DataFrame, list[DataFrame], DataFrame]:
    """(state, orphans, snapshots, transitions) after further slices. start: references without a moment are taken with the first slice."""
    lo, hi = bounds[0][0], bounds[-1][1]
    moves, refs = _between(moves, lo, hi, False), _between(refs, lo, hi, start)
    live = state.live.unionByName(moves.groupBy("uid").agg(F.sum("delta").alias("open"))).groupBy("uid").agg(F.sum("open").alias("open")).where("open <> 0")
    waiting = state.waiting.unionByName(refs.groupBy("uid", "predicate").agg(F.count("*").alias("refs"))).groupBy("uid", "predicate").agg(F.sum("refs").alias("refs"))
    lines = timeline(state, moves, refs, bounds)
    at_end = pending(lines, len(bounds))
    return OrphanState(live, waiting), probe(state.live, moves, refs), [at_end.where(F.col("slice") == i) for i in range(len(bounds))], transitions(lines)


def months(moves: DataFrame, refs: DataFrame) -> list[str]:
    """The calendar months in which a reference is made or a record arrives or is deleted."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return sorted(r.month for r in moves.select(month).union(refs.select(month)).where("month is not null").distinct().collect())  # twelve a year


def by_month(names: list[str]) -> list[tuple]:
    """Bounds of one slice a month; the first and the last are open."""
    edges = [None, *(F.lit(f"{m}-01").cast("timestamp") for m in names[1:]), None]
    return list(zip(edges, edges[1:]))


def slices(moves: DataFrame, refs: DataFrame, n: int) -> list[tuple]:
    """Bounds of n equal slices of the time that the references cover."""
    lo, hi = refs.agg(F.min("at"), F.max("at")).first()
    if lo is None:
        return [(None, None)]
    step = (hi - lo) / n
    edges = [None, *(lo + step * i for i in range(1, n)), None]
    return list(zip(edges, edges[1:]))


def _between(df: DataFrame, lo, hi, nulls: bool) -> DataFrame:
    at = F.col("at")
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (at >= F.lit(lo))
    if hi is not None:
        keep = keep & (at < F.lit(hi))
    return df.where(keep | (at.isNull() if nulls else F.lit(False)))


def orphans(relations: DataFrame, entities: list[DataFrame], chunks: DataFrame, n_slices: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(all orphan references, pending counts at the end of every slice): a slice a calendar month, or n equal slices."""
    moves = cut(changes(entities, chunks))
    refs = cut(references(relations))
    bounds = slices(moves, refs, n_slices) if n_slices else by_month(months(moves, refs))
    _, found, snapshots, _ = go_on(OrphanState.empty(relations.sparkSession), moves, refs, bounds)
    return found, snapshots


def pending_by_month(relations: DataFrame, entities: list[DataFrame], chunks: DataFrame) -> DataFrame:
    """(month, predicate, kind, pending): the snapshots of all months; none where nothing has a moment."""
    moves = cut(changes(entities, chunks))
    refs = cut(references(relations))
    names = months(moves, refs)
    lines = timeline(OrphanState.empty(relations.sparkSession), moves, refs, by_month(names))
    month = F.get(F.array(*map(F.lit, names)).cast("array<string>"), F.col("slice"))
    return pending(lines, max(len(names), 1)).select(month.alias("month"), "predicate", "kind", "pending").where("month is not null")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per predicate, kind of record referred to, and month of recording."""
    month = F.date_format("at", "yyyy-MM")
    return found.groupBy("predicate", kind_of(F.col("uid")).alias("kind"), month.alias("month")).agg(F.count("*").alias("orphans"))
