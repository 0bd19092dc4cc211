import random

import pyarrow as pa

from stratagraph.llm import subjects as S

A = {"law": ["court", "judge", "clause", "plaintiff", "statute", "verdict"], "music": ["guitar", "violin", "melody", "chorus", "tempo", "singer"], "sport": ["goal", "striker", "sprint", "coach", "league", "medal"], "food": ["bread", "butter", "oven", "recipe", "flour", "spoon"]}
FILL = ["See the attachment for the longer story.", "Nothing else changed since then.", "Thanks for the quick answer."]
DOC = "doc_id long, text string, source string, lang string, subject string"


def corpus(n=240, seed=4):
    r = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        own = r.choice([[], ["law"], ["music"], ["sport"], ["food"], r.sample(sorted(A), 2)])
        sents = [r.choice(FILL) for _ in range(4)]
        for s in own:
            sents += [f"Per the handbook, the {r.choice(A[s])} meets another {r.choice(A[s])} of board{r.randint(1, 9)}." for _ in range(4)]
        r.shuffle(sents)
        docs.append((i, " ".join(sents), " Wiki" if i % 2 else "wiki", "en-US" if i % 3 else "EN", "!"))
        truth |= {(i, s): 1 for s in own}
        if i % 4 == 0:
            for who in ("a", "b"):
                labels += [(i, s.upper() + " ", who) for s in own] or [(i, "none", who)]
            if i % 20 == 0:
                labels.append((i, "music", "c"))
    return docs, truth, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([*((s, "x") for s in A), (None, "z")], "subject string, description string")


def test_labels_reach_unlabelled_documents(spark):
    docs, truth, labels = corpus()
    d, lab, areas = tables(spark, docs + [(900, None, None, None, "!"), (901, " ", None, None, "!"), (902, "...", None, None, "!")] + docs[:3], labels + labels[:5] + [(1, "astrology", "a"), (None, "law", "a")])
    found = S.subjects(d, lab, areas)
    got = {(r.doc_id, r.subject) for r in found.collect()}
    assert len(got ^ set(truth)) <= 0.02 * len(truth)
    comp = S.composition(d, found)
    assert {r.source for r in comp.collect()} == {"wiki"} and {r.lang for r in comp.collect()} == {"en"}


def test_quoted_items_do_not_count(spark):
    docs, truth, labels = corpus()
    item = "The guitar clause tempo meets a verdict while many threads spin around"
    docs.append((500, (item + ". ") * 5 + "See the attachment for the longer story.", "wiki", "en", "!"))
    d, lab, areas = tables(spark, docs, labels)
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, item_text string")
    assert 500 not in {r.doc_id for r in S.subjects(d, lab, areas, items).collect()}


def test_empty(spark):
    docs, _, labels = corpus(8)
    d, lab, areas = tables(spark, docs, labels)
    assert S.subjects(d.limit(0), lab, areas).count() == 0
    assert S.subjects(d, lab.limit(0), areas).count() == 0
    assert S.subjects(d, lab, areas.limit(0)).count() == 0


def test_sentences():
    assert S.sentences("A b. C d!\n\nE f? ... - g") == ["A b.", "C d!", "E f?", "- g"]
    assert S.sentence_words("The motor_12 Guitar, guitar plays at 3 o'clock!") == {"guitar", "plays", "the"}
    long = "word " * 100000 + "."
    assert len(S.sentences(long)) == 1


def test_bursty_words(spark):
    docs = [(i, " ".join(["Filler text here."] * 1 + (["The violin plays."] * 5 if i % 5 == 0 else [])), "w", "en", "!") for i in range(40)]
    split = S.split_documents(spark.createDataFrame(docs, DOC), None)
    assert {r.word for r in S.bursty_words(split.where("doc_id is null")).collect()} == {"the", "violin", "plays"}


def test_links_are_verified_and_stars(spark):
    sets = {1: "alpha beta gamma delta", 2: "alpha beta gamma omega", 3: "alpha tau", 4: "kappa rho sigma tau", 5: "alpha beta gamma delta"}
    keys = spark.createDataFrame([(k, k, v) for k, v in sets.items()], "a long, b int, key string")
    words = spark.createDataFrame([(w,) for w in {w for v in sets.values() for w in v.split()}], "word string")
    nodes, members, links = S.passage_graph(keys, words)
    of = {r.core: sets[r.a] for r in members.collect()}
    assert nodes.count() == 4 and len({r.core for r in members.collect() if r.a in (1, 5)}) == 1
    for r in links.collect():
        x, y = set(of[r.src].split()), set(of[r.dst].split())
        assert len(x & y) >= len(x | y) / 3
    assert {(r.src, r.dst) for r in links.collect()} == {(r.dst, r.src) for r in links.collect()}


def test_a_subject_goes_over_links_and_trusted_documents_stay(spark):
    shape = "core long, subject string, mass double"
    nodes, links = spark.createDataFrame([(i,) for i in range(6)], "core long"), spark.createDataFrame([(a, b) for i, j in ((0, 1), (1, 2), (3, 4)) for a, b in ((i, j), (j, i))], "src long, dst long")
    mass = spark.createDataFrame([(0, "law", 5.0), (3, "music", 5.0), (3, "none", 1.0)], shape)
    assert {tuple(r) for r in S.spread(nodes, links, mass, ["law", "music"]).collect()} == {(0, "law"), (1, "law"), (2, "law"), (3, "music"), (4, "music")}
    docs, _, labels = corpus(120)
    docs.append((700, "Nothing else changed since then. Thanks for the quick answer.", "wiki", "en", "!"))
    d, lab, areas = tables(spark, docs, labels + [(700, "law", "a"), (700, "law", "b")])
    assert [r.subject for r in S.subjects(d, lab, areas).where("doc_id = 700").collect()] == ["law"]


def test_every_similar_pair_is_a_link(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(14)]
    sets = {frozenset(r.sample(words, r.choice([1, 1, 2, 3, 4, 5, 6]))) for _ in range(150)}
    keys = [(i, i, " ".join(sorted(s))) for i, s in enumerate(sorted(sets, key=sorted))]
    want = {(x, y) for x, _, a in keys for y, _, b in keys if x != y and 3 * len(set(a.split()) & set(b.split())) >= len(set(a.split()) | set(b.split()))}
    frames = spark.createDataFrame(keys, "a long, b int, key string"), spark.createDataFrame([(w,) for w in words], "word string")
    for block in (S.BLOCK, 40):
        monkeypatch.setattr(S, "BLOCK", block)
        _, members, links = S.passage_graph(*frames)
        of = {m.core: m.a for m in members.collect()}
        got = [(of[x.src], of[x.dst]) for x in links.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_block_gives_its_pairs_out_in_parts(monkeypatch):
    rows = pa.RecordBatch.from_pydict({"core": pa.array([0, 1, 2, 1 << 33, (1 << 33) + 1], pa.int64()), "words": pa.array([[5, 6], [5], [9], [5, 6, 7], [9]], pa.list_(pa.int64()))})
    want = {(0, 1 << 33), (1, 1 << 33), (2, (1 << 33) + 1)}
    for pairs in (S.FLUSH_PAIRS, 1):
        monkeypatch.setattr(S, "FLUSH_PAIRS", pairs)
        got = sorted((d, b + s) for out in S._similar((pa.scalar(0), pa.scalar(1)), iter([rows])) for d, b, of in zip(*out.to_pydict().values()) for s in of)
        assert got == sorted(want | {(y, x) for x, y in want})
