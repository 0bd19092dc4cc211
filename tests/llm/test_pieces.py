import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm import pieces as P

CH = "chunk_id long, chunk_type string, line_start int, line_end int, content string, max_chars string"
LIM = [("fixed_window", 100, 10), ("section", 60, 12), ("none", 50, 0)]


def check(spark, rows, size=1 << 17):
    lim = spark.createDataFrame(LIM, "chunk_type string, max_chars int, overlap_chars int")
    got: dict = {}
    for r in P.split_oversized(spark.createDataFrame(rows, CH), lim, size).collect():
        got.setdefault(r.chunk_id, []).append(r)
    by = {k: (m, o) for k, m, o in LIM}
    want = {r[0] for r in rows if r[4] is not None and (r[1] or "fixed_window") in by and len(r[4]) > by[r[1] or "fixed_window"][0]}
    assert set(got) == want
    for cid, kind, first, _, text, _ in rows:
        if cid not in got:
            continue
        most, overlap = by[kind or "fixed_window"]
        ps = sorted(got[cid], key=lambda r: r.piece_no)
        pos = 0
        for i, p in enumerate(ps):
            assert p.piece_no == i and 0 < len(p.content) <= most
            a = pos - overlap if i else 0
            assert text[a : a + len(p.content)] == p.content
            assert p.line_start == (first or 1) + text.count("\n", 0, a)
            pos = a + len(p.content)
            assert p.line_end == p.line_start + p.content.removesuffix("\n").count("\n")
        assert pos == len(text)
    return got


@pytest.mark.parametrize("size", [1 << 17, 64, 200])
def test_pieces_make_up_the_text(spark, size):
    r = random.Random(1)
    words = ["alpha", "ßeta", "日本", "😀", "x" * 30, "\n", "\n\n", "\r\n", ". ", "# h\n", "\t"]
    rows = []
    for i in range(30):
        rows.append((i, r.choice([None, "section", "fixed_window", "none", "other"]), r.choice([1, 7, None]), 3, " ".join(r.choice(words) for _ in range(r.randint(0, 120))), "z"))
    rows += [(100, None, 1, 1, "x" * 1000, "z"), (101, None, 1, 1, "y" * 100, "z"), (102, None, 1, 1, "y" * 101, "z"), (103, None, 1, 1, None, "z"), (104, None, 1, 1, "", "z"), (105, "section", 1, 1, "\r\n" * 200, "z")]
    check(spark, rows + rows[:4], size)


def test_long_items_take_several_segments(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_CELLS", 16)
    check(spark, [(1, "section", 1, 1, "word and more words here\n" * 400, "z"), (2, "section", 5, 1, "z" * 9000, "z")], 256)


def test_rows_without_id(spark):
    lim = spark.createDataFrame(LIM, "chunk_type string, max_chars int, overlap_chars int")
    assert P.split_oversized(spark.createDataFrame([(None, None, 1, 1, "x " * 200, "z")], CH), lim).count() == 0


def test_cuts_are_natural_where_they_can_be(spark):
    text = "\n\n".join("word " * 6 for _ in range(40))
    ps = sorted(check(spark, [(1, None, 1, 1, text, "z")])[1], key=lambda r: r.piece_no)
    assert all(p.content.endswith("\n\n") for p in ps[:-1])


def test_empty_and_bad_limits(spark):
    lim = spark.createDataFrame([("fixed_window", 10, 9)], "chunk_type string, max_chars int, overlap_chars int")
    none = spark.createDataFrame([], CH)
    assert P.split_oversized(none, lim).count() == 0
    with pytest.raises(Exception, match="overlap_chars"):
        P.split_oversized(spark.createDataFrame([(1, None, 1, 1, "x" * 50, "z")], CH), lim).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2000), st.integers(0, 4)), max_size=60), st.integers(40, 200))
def test_choose_keeps_within_reach(cells, room):
    import numpy as np

    at = {p: s for p, s in cells} | {p: 0 for p in range(5, 2001, 5)}
    pos = np.array(sorted(at))
    cuts = P.choose(pos, np.array([at[p] for p in sorted(at)]), 0, room, room, 10)
    edges = [0, *cuts, int(pos[-1])]
    assert all(0 < b - a <= room for a, b in zip(edges, edges[1:]))
    assert all(b - a >= 10 for a, b in zip(edges, edges[1:-1]))


def test_headings_are_boundaries():
    strong = P._BREAKS[-1][1]
    at = lambda t: [t[m.end() :][:6] for m in strong.finditer(t)]
    assert at("a line\n# Heading\nmore\n== Wiki ==\nx\n\\section{a}\n<h2>b</h2>\nplain\n") == ["# Head", "== Wik", "\\secti", "<h2>b<"]
    assert at("int f()\n{\n}\nint g()\n{ }\n") == ["int g("] and at("one\n\ntwo\nthree") == ["two\nth"]


def test_files_are_read_by_offset(spark, tmp_path):
    text = "".join(f"line {i} of the file with ü and 日本.\n" + ("\n" if i % 9 == 0 else "") for i in range(700))
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"short")
    (tmp_path / "c.txt").write_bytes(b"")
    files = spark.createDataFrame([(1, str(tmp_path / "a.txt"), len(text.encode())), (2, "file://" + str(tmp_path / "b.txt"), 5), (3, str(tmp_path / "c.txt"), 0)], "chunk_id long, path string, bytes long")
    got = sorted(P.split_files(files, 400, 40, 512).collect(), key=lambda r: r.piece_no)
    assert {r.chunk_id for r in got} == {1} and all(len(r.content) <= 400 for r in got)
    assert "".join(r.content[40 if r.piece_no else 0 :] for r in got) == text
    whole = spark.createDataFrame([(1, "x", 1, 1, text, "z")], CH)
    same = P.split_oversized(whole, spark.createDataFrame([("x", 400, 40)], "chunk_type string, max_chars int, overlap_chars int"), 512)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got))
