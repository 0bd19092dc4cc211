from stratagraph.llm import leak

TEXT = "One two three, four five six seven eight nine ten eleven TWELVE thirteen."


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = leak.normal_words(t or "")
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, x in items:
            v = leak.normal_words(x or "")
            if any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    items = [(1, "b", TEXT), (2, "b", TEXT), (3, "c", None), (4, "c", "too short"), (5, "c", "İstanbul ß " + TEXT[:40] + " x y z a b c d e f"), (6, "c", "")]
    docs = [(1, "xx " + TEXT.upper().replace(" ", "\n>  ") + " yy", "!"), (2, TEXT[4:], "!"), (3, None, "!"), (4, "", "!"), (5, "q " * 300000 + TEXT, "!"), (6, "ü_One-two three (four) five six seven eight nine ten eleven twelve", "!"), (7, "İstanbul ß " + TEXT[:40] + " x y z a b c d e f", "!"), (1, "xx " + TEXT.upper(), "!"), (8, TEXT.replace("seven", "7"), "!")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, benchmark string, item_text string")
    got = leak.find_leaks(d, i)
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute([(a, b) for a, b, _ in docs], [(a, c) for a, _, c in items], 12)
    assert len(rows) == len({(r.doc_id, r.item_id, r.first_char, r.last_char) for r in rows})
    five = next(r for r in rows if r.doc_id == 5 and r.item_id == 1)
    assert docs[4][1][five.first_char : five.last_char] == TEXT[:-1]
    rep = {r.benchmark: (r["items"], r.leaked_items) for r in leak.leaked_items(got, i).collect()}
    assert rep == {"b": (2, 2), "c": (4, 1)}
    assert leak.find_leaks(d, i.limit(0)).count() == 0 and leak.find_leaks(d.limit(0), i).count() == 0


def test_the_bound_on_items_is_checked(spark):
    i = spark.createDataFrame([(1, "b", "x" * 100)], "item_id long, benchmark string, item_text string")
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    try:
        leak.find_leaks(d, i, max_item_chars=10)
        raise AssertionError
    except ValueError as e:
        assert "max_item_chars" in str(e)


def test_answers_mark_leaks_and_make_none(spark):
    i = spark.createDataFrame([(1, TEXT, "Forty-two!"), (2, TEXT, "blue"), (3, "short", "nothing else")], "item_id long, item_text string, answer string")
    d = spark.createDataFrame([(1, TEXT + " It is forty two."), (2, TEXT), (3, "forty two nothing else " * 9)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.with_answer) for r in leak.find_leaks(d, i).collect()} == {(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, False)}


def test_two_passages_of_an_item_are_two_spans(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words[:13]) + " " + "other words " * 40 + " ".join(words[20:34]) + "."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, item_text string")
    got = sorted(leak.find_leaks(d, i).collect(), key=lambda r: r.first_char)
    assert [text[r.first_char : r.last_char].split() for r in got] == [words[:13], words[20:34]]
    assert [r.words for r in got] == [13, 14]
