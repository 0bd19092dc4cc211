import numpy as np

from stratagraph.llm.markup import clean, leaves, lstm, train
from stratagraph.llm.markup import operator as O


def marked(text):
    rows, labels = leaves.leaves(text), O.label([text])[0]
    return bool(O.signs(rows, labels))


def test_marked_and_plain():
    yes = ["Title\n=====\n\nMore text here.", "# Head\n\ntext", "* **a**: b c d", "See [the guide](x/y.md).", "```c\nint a;\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "{| class=\"wikitable\"\n! a !! b\n|-\n| 1 || 2\n|}", "'''Bold''' ''it'' text", "text <ref>log 3</ref>", "[[Category:x]]", "{{note|some text here}}", "\\section{Queue}", "\\begin{itemize}\n\\item one two\n\\end{itemize}", "The error is $e_{k} = \\frac{x}{y}$.", "\\[ t = 3 \\cdot n \\]", "<ul>\n<li>one two three</li>\n</ul>", "a &lt; b &amp;&amp; c", "text here <!-- note --> and on", "Call `start()` first.", "~~Obsolete since r3~~ text"]
    no = ["Plain text, nothing else.", "Reads __attr_ring and cfg_pin_max, then clamps x_1 and x_2 for the shell.", "Uses 2^41 steps per turn & one cursor per axis, as the core expects (a > b).", "Holds while head < tail and tail - head <= 38, so buf[i] never wraps past the pin.", "Returns C# style error codes #1 to #90 whenever it stays idle.", "Needs stdint.h from the C library; costs about $5 of parts on the board.", "Scales raw counts by 3 * gain * 87 / 1024 before use.", ""]
    assert [t for t in yes if not marked(t)] == []
    assert [t for t in no if marked(t)] == []


def test_comment_marks_are_no_markup():
    f = leaves.without_marks
    assert not marked(f("/*\n * Waits until the pin is idle.\n *\n * @param dev device to act on\n */", "tree-sitter-c"))
    assert not marked(f("/// Waits until idle now.\n/// \\param dev device to act on", "tree-sitter-c"))
    assert not marked(f("# Waits until the pin is idle.\n# And more.", "python-ast"))
    assert marked(f("/*\n * ~~~\n * x = 1;\n * ~~~\n * text\n */", "tree-sitter-c"))
    assert marked(f("## Queue notes\n\nText follows here.", "tree-sitter-c"))


def test_held_out_accuracy():
    leaf, text = train.held_out(O.weights(), 600, seed=1234)
    assert leaf > 0.98 and text > 0.99


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = lstm.initial(leaves.BUCKETS, 3)
    seqs = [leaves.features("# a\n\ntext b\n* c"), leaves.features("x = 1")]
    labels = np.array([2, 0, 3, 0])
    loss, g = lstm.gradients(p, seqs, labels)
    for k in ("Wf", "Wb", "V", "E", "Bf"):
        flat = np.flatnonzero(np.abs(g[k]).ravel() > 1e-6)
        for i in rng.choice(flat, 3):
            old = p[k].ravel()[i]
            p[k].ravel()[i] = old + 1e-5
            up, _ = lstm.gradients(p, seqs, labels)
            p[k].ravel()[i] = old
            assert abs((up - loss) / 1e-5 - g[k].ravel()[i]) < 1e-3


def test_training_learns_something_quickly():
    p = train.train(steps=60, batch=16, say=lambda *_: None)
    assert train.held_out(p, 150)[0] > 0.5


def test_cleaning_keeps_structure():
    text = "Title\n=====\n\nSee [the guide](x.md) and **bold** &lt; text.\n\n* **a**: one two three\n* *b*: two three four\n\n```c\nint x = *p;\n```\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n\\[ t = 3 \\cdot n \\]"
    rows, labels = leaves.leaves(text), O.label([text])[0]
    body, blocks = clean.render(rows, labels)
    assert [k for k, _ in blocks] == ["heading", "paragraph", "list", "code", "table", "formula"]
    assert "See the guide and bold < text." in body and "• a: one two three" in body and "    int x = *p;" in body and "h | k\n1 | 2" in body and "t = 3 \\cdot n" in body
    assert not any(s in body for s in ("](", "**", "```", "====", "|---", "&lt;"))


def test_operator(spark):
    c = spark.createDataFrame([(1, "section", "# Head\n\ntext"), (2, "section", "plain words only here"), (3, "fixed_window", "# Head"), (4, "section", None), (5, "section", "  "), (1, "section", "# Head\n\ntext"), (6, "section", "word " * 60000 + "\n" + "line of text\n" * 3000 + "**bold** end")], "chunk_id long, chunk_type string, content string")
    e = spark.createDataFrame([(1, "tree-sitter-c", "<b>x</b> text", "!"), (2, None, None, "!"), (-3, "python-ast", "plain", "!")], "entity_id long, extraction_method string, description string, text string")
    t = O.texts_of(c, e)
    assert {(r.tab, r.row_id) for r in O.clean_texts(t, render=False).collect()} == {("source_chunks", 1), ("source_chunks", 6), ("entities", 1)}
    full = {(r.tab, r.row_id): r for r in O.clean_texts(t).collect()}
    assert len(full) == 5 and full[("entities", 1)].text == "x text" and full[("entities", -3)].text == "plain" and not full[("source_chunks", 2)].marked
    assert O.clean_texts(t.limit(0)).count() == 0


def test_the_labeller_decides_and_not_the_signs_alone():
    import random

    maker = train.Maker(random.Random(4321))
    made = [(t, w) for t, w in (maker.text() for _ in range(1500)) if w and len(leaves.leaves(t)) == len(w)]
    truth = np.array([any(w) for _, w in made])
    rows = [leaves.leaves(t) for t, _ in made]
    signs = np.array([bool(O.signs(r, np.ones(len(r), int))) for r in rows])
    labels = O.label([t for t, _ in made])
    alone = np.array([bool((x != 0).any()) for x in labels])
    both = np.array([bool(O.signs(r, x)) for r, x in zip(rows, labels)])
    assert (alone != truth).sum() < (signs != truth).sum() and (both != signs).any()


def test_a_text_is_one_sequence_however_long():
    text = "```\n" + "x = 1;\n" * 3000 + "```\nplain words\n" + "<div>\n" * 700 + "end"
    rows, labels = leaves.leaves(text), O.label([text])[0]
    assert len(rows) == len(labels) and len({id(p) for _, p, _ in rows}) < 20
    assert max(len(p) for _, p, _ in rows) == 1
