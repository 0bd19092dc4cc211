"""Orphan references against a brute-force reading of the rule, in one slice and in several, with and without hot uids."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import orphans as O
from stratagraph.streaming.orphans import orphan_events

T0 = datetime(2025, 1, 1)
ENT = "entity_type string, source_file string, name string, ingested_at timestamp, deleted_at timestamp"
CH = "uid string, ingested_at timestamp"
REL = "relation_id long, subject string, predicate string, object string, ingested_at timestamp, extra string"


def brute(rels, lives):
    out = set()
    for i, s, _, o, at, *_ in rels:
        for end, v in (("subject", s), ("object", o)):
            if v is None:
                continue
            v = v.strip(" \t").replace("\\", "/")
            if not v or v.startswith("external:"):
                continue
            if at is None or not any(u == v and a <= at and (z is None or z > at) for u, a, z in lives):
                out.add((i, end))
    return out


def world(seed, n=300):
    r = random.Random(seed)
    when = lambda: T0 + timedelta(minutes=r.randint(0, 60 * 24 * 9))
    ents, lives = [], []
    for k in range(40):
        name = f"f{r.randint(0, 15)}"
        a = when()
        z = r.choice([None, None, a + timedelta(minutes=r.randint(-5, 9000)), a])
        ents.append(("Function", "a/b.c", name, a, z))
        if z is None or z > a:
            lives.append((f"Function|a/b.c|{name}", a, z))
    ents += ents[:5]
    ents.append(("KconfigOption", "x/Kconfig", "OPT", T0, None))
    lives.append(("KconfigOption|OPT", T0, None))
    ents.append(("Folder", "a", "a", None, None))
    chunks = [("SourceChunk|a/b.c|1-2|ff", T0 + timedelta(days=3)), (None, T0)]
    lives.append(("SourceChunk|a/b.c|1-2|ff", T0 + timedelta(days=3), None))
    pick = lambda: r.choice([f"Function|a/b.c|f{r.randint(0, 17)}", " Function|a/b.c|f1\t", "Function|a\\b.c|f2", "external:x", None, "", " \t", "KconfigOption|OPT", "SourceChunk|a/b.c|1-2|ff", "Folder|a", "function|a/b.c|f1", "Function|a/b.c|f0", "Function|a/b.c|f0"])
    rels = [(i, pick(), "CALLS", pick(), r.choice([when(), when(), a, None]), "z") for i in range(n)]
    return ents, chunks, rels + rels[:20], lives


@pytest.mark.parametrize("seed,slices,hot", [(1, 1, 10**9), (2, 3, 10**9), (3, 1, 20), (4, 3, 20)])
def test_against_brute_force(spark, monkeypatch, seed, slices, hot):
    monkeypatch.setattr(O, "HOT_ROWS", hot)
    monkeypatch.setattr(O.probe, "__defaults__", (3600, hot))
    ents, chunks, rels, lives = world(seed)
    found, snaps = O.orphans(spark.createDataFrame(rels, REL), [spark.createDataFrame(ents, ENT)], spark.createDataFrame(chunks, CH), slices)
    got = [(r.relation_id, r.endpoint) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rels, lives)
    assert len(snaps) == slices
    pending = sum(r.pending for r in snaps[-1].collect())
    end = T0 + timedelta(days=4000)
    alive = {u for u, a, z in lives if z is None}
    want = sum(1 for i, s, _, o, at, *_ in {x[0]: x for x in rels}.values() for v in (s, o) if v and v.strip(" \t") and not v.strip(" \t").startswith("external:") and v.strip(" \t").replace("\\", "/") not in alive)
    assert pending == want and end


def test_empty_tables(spark):
    found, snaps = O.orphans(spark.createDataFrame([], REL), [spark.createDataFrame([], ENT)], spark.createDataFrame([], CH))
    assert found.count() == 0 and snaps[-1].count() == 0


def test_boundaries_are_inclusive_and_exclusive(spark):
    a, z = T0, T0 + timedelta(hours=1)
    ents = [("Function", "f", "x", a, z)]
    rels = [(1, "Function|f|x", "P", None, a, ""), (2, "Function|f|x", "P", None, z, ""), (3, "Function|f|x", "P", None, a - timedelta(microseconds=1), ""), (4, "Function|f|x", "P", None, z - timedelta(microseconds=1), "")]
    found, _ = O.orphans(spark.createDataFrame(rels, REL), [spark.createDataFrame(ents, ENT)], spark.createDataFrame([], CH))
    assert {r.relation_id for r in found.collect()} == {2, 3}
    counts = O.orphan_counts(found).collect()
    assert [(r.predicate, r.kind, r.month, r.orphans) for r in sorted(counts, key=lambda r: r.month)] == [("P", "Function", "2024-12", 1), ("P", "Function", "2025-01", 1)]


def test_stream(spark, tmp_path):
    shape = "uid string, at timestamp, what string, relation_id long, endpoint string"
    rows = [("u", T0, "ref", 1, "subject"), ("u", T0 + timedelta(1), "arrive", None, None), ("u", T0 + timedelta(2), "ref", 2, "object"), ("u", T0 + timedelta(3), "delete", None, None), ("u", T0 + timedelta(4), "ref", 3, "object")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = orphan_events(stream, salts=1).writeStream.format("memory").queryName("orphan_events").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["at"], r["what"], r["relation_id"], r["refs"]) for r in spark.table("orphan_events").collect())
    assert [g[1:] for g in got] == [("orphan", 1, 1), ("resolved", None, 1), ("reopened", None, 2), ("orphan", 3, 1)]


def test_endpoint_reading(spark):
    df = spark.createDataFrame([("\t a\\b ",), (None,)], "s string").select(O.endpoint(F.col("s")).alias("e"))
    assert [r.e for r in df.collect()] == ["a/b", None]


def test_two_runs_with_a_saved_state_give_what_one_gives(spark, tmp_path):
    ents, chunks, rels, _ = world(7)
    moves, refs = O.changes([spark.createDataFrame(ents, ENT)], spark.createDataFrame(chunks, CH)), O.references(spark.createDataFrame(rels, REL))
    half = T0 + timedelta(days=4)
    rows = lambda df: sorted((r.relation_id, r.endpoint) for r in df.collect())
    empty = O.OrphanState.empty(spark)
    state, whole, snaps, _ = O.go_on(empty, moves, refs, [(None, None)])
    first, a, _, _ = O.go_on(empty, moves, refs, [(None, half)])
    first.save(str(tmp_path / "s"))
    loaded = O.OrphanState.load(spark, str(tmp_path / "s"))
    end, b, later, moved = O.go_on(loaded, moves, refs, [(half, None)], start=False)
    assert sorted(rows(a) + rows(b)) == rows(whole)
    key = lambda df: {(r.predicate, r.kind, r.pending) for r in df.collect()}
    assert key(later[-1]) == key(snaps[-1])
    live = lambda st: {r.uid for r in st.live.where("open > 0").collect()}
    waits = {r.uid for r in loaded.waiting.collect()}
    assert {(r.uid, r.what) for r in moved.collect()} == {(u, "resolved") for u in (live(end) - live(loaded)) & waits} | {(u, "reopened") for u in (live(loaded) - live(end)) & waits}


def test_every_month_has_a_snapshot(spark):
    month = lambda m: datetime(2025, m, 10)
    ents = [("Function", "f", "x", month(3), month(6)), ("Function", "f", "y", month(1), month(9))]
    rels = [(1, "Function|f|x", "P", "Function|f|y", month(1), ""), (2, "Function|f|x", "P", None, month(4), ""), (3, "Function|f|z", "Q", None, None, "")]
    tables = spark.createDataFrame(rels, REL), [spark.createDataFrame(ents, ENT)], spark.createDataFrame([], CH)
    got = {(r.month, r.predicate): r.pending for r in O.pending_by_month(*tables).collect()}
    assert got == {("2025-01", "P"): 1, ("2025-06", "P"): 2, ("2025-09", "P"): 3} | {(f"2025-0{m}", "Q"): 1 for m in (1, 3, 4, 6, 9)}
    snaps = O.orphans(*tables)[1]
    assert [{r.predicate: r.pending for r in s.collect()} for s in snaps] == [{"P": 1, "Q": 1}, {"Q": 1}, {"Q": 1}, {"P": 2, "Q": 1}, {"P": 3, "Q": 1}]
    assert O.pending_by_month(tables[0].limit(0), [tables[1][0].limit(0)], tables[2]).count() == 0


def test_snapshots_against_brute_force(spark):
    ents, chunks, rels, lives = world(11)
    tables = spark.createDataFrame(rels, REL), [spark.createDataFrame(ents, ENT)], spark.createDataFrame(chunks, CH)
    moves, refs = O.changes(*tables[1:]), O.references(tables[0])
    edges = [T0 + timedelta(hours=h) for h in range(30, 200, 30)]
    _, _, snaps, _ = O.go_on(O.OrphanState.empty(spark), moves, refs, list(zip([None, *edges], [*edges, None])))
    for end, snap in zip([*edges, datetime(2030, 1, 1)], snaps):
        live = {u for u, a, z in lives if a < end and (z is None or z >= end)}
        want = sum(1 for _, s, _, o, at, _ in set(rels) if at is None or at < end for v in (s, o) if v and (w := v.strip(" \t").replace("\\", "/")) and not w.startswith("external:") and w not in live)
        assert sum(r.pending for r in snap.collect()) == want
