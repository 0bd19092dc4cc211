"""Markup behind the 48th character of a token, or far into a long line, is seen."""

import pytest

from stratagraph.llm.markup import operator
from stratagraph.llm.markup.leaves import LONG, leaves, pieces, shape


@pytest.mark.parametrize(("text", "sign"), [
    ("A note.\n\nSee " + "drivers/" * 7 + "<b>bold</b> for more of it.\n", "tag"), ("Some plain text " + "a" * 60 + "<br/>next word here.\n", "tag"),
    ("Plain words " + "x_y" * 20 + "&nbsp;and more words.\n", "entity"), ("Text " + "q-" * 30 + "[a](http://b.c) more.\n", "link"), ("plain words, here and " * 400 + "`x` end.\n", "code"),
])
def test_signs_far_into_a_token_or_line(text, sign):
    labels = operator.label([text])[0]
    assert operator.signs(leaves(text), labels) == [sign]


def test_long_plain_texts_stay_plain():
    text = "See " + "drivers/serial/" * 6 + "uart.c for more of it.\n" + "plain words here " * 200
    assert operator.signs(leaves(text), operator.label([text])[0]) == []


def test_nothing_of_a_line_is_left_out():
    assert shape("a" * 60 + "<b>") == "a<a>"
    for n in (1, LONG, 2 * LONG, 2 * LONG + 1, 500):
        assert len(pieces("x" * n, (), True)) == max(1, -(-(n - LONG) // LONG))
