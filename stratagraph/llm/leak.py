"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over words holds every run of ``words`` consecutive words of every test item, and every
whole answer; each document is split into words and scanned once, and hits are mapped back to offsets of the original
text. A run makes a leak; an answer alone does not (answers are short and common), but a leak says whether the document
has it as well. Answers of a single character are the letters of choices and are not looked for. Runs that follow each
other without a gap are one passage; two passages of one item in a document are two rows.

A word is a longest run of letters and digits, compared without case. Items or documents that are null, blank or have
fewer words than a run never match; items with one text are cases of their own; a repeated document row gives the
same rows again, made distinct at the end. The items are the bounded side: the automaton refuses more than
``MAX_ITEM_CHARS`` characters of them (raise the parameter knowingly: a worker needs some hundred bytes a character).
It is built once per worker process, from word numbers, and kept for all its tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_WORDS = 12
MAX_ITEM_CHARS = 2_000_000
WORD = re.compile(r"[^\W_]+")
HITS = "doc_id long, item_id long, first_char long, last_char long, words long, with_answer boolean"
HITS_NAMES = [c.split()[0] for c in HITS.split(", ")]


def normal_words(text: str) -> list[str]:
    """Words in lower case; joined first, since one call is cheaper and no word gets a blank by it."""
    return " ".join(WORD.findall(text)).lower().split(" ")


def runs(items: list[tuple[int, str]], words: int) -> dict[tuple[str, ...], list[int]]:
    """Every run of words of the items -> the items that have it."""
    out: dict[tuple[str, ...], list[int]] = {}
    for item, text in items:
        w = normal_words(text)
        for i in range(len(w) - words + 1):
            have = out.setdefault(tuple(w[i : i + words]), [])
            if not have or have[-1] != item:
                have.append(item)
    return out


class Finder:
    """The automaton and the numbers of the words it knows; 0 is every other word, which no run has."""

    def __init__(self, items: list[tuple[int, str]], words: int, answers: list[tuple[int, str]] = ()):
        import ahocorasick

        self.words = words
        found = runs(items, words)
        replies: dict[tuple[str, ...], list[int]] = {}
        for item, text in answers:
            w = normal_words(text)
            if len("".join(w)) > 1:
                replies.setdefault(tuple(w), []).append(item)
        self.number: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in found.keys() | replies.keys():
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in key)
            self.automaton.add_word(ids, (found.get(key, ()), replies.get(key, ())))
        self.empty = not found
        self.anchors = None
        if not self.empty:
            self.automaton.make_automaton()
            longest = [max((w for w in run if w.isascii()), key=len, default="") for run in found]
            if all(longest):  # a text without the longest word of any run has no run
                self.anchors = ahocorasick.Automaton()
                for w in longest:
                    self.anchors.add_word(w, True)
                self.anchors.make_automaton()

    def passages(self, text: str) -> tuple[list[tuple[int, int, int]], set[int]]:
        """((item, first word, word behind the last) of every passage, items whose answer is in the text)."""
        if self.empty or (self.anchors is not None and next(self.anchors.iter(text.lower()), None) is None):
            return [], set()
        w = normal_words(text)
        if len(w) < self.words:
            return [], set()
        get = self.number.get
        open_: dict[int, list[int]] = {}
        out: list[tuple[int, int, int]] = []
        answered: set[int] = set()
        for end, (ids, answers) in self.automaton.iter(tuple([get(x, 0) for x in w])):
            answered.update(answers)
            for item in ids:
                first = end - self.words + 1
                have = open_.get(item)
                if have and first <= have[1]:
                    have[1] = end + 1
                else:
                    if have:
                        out.append((item, *have))
                    open_[item] = [first, end + 1]
        return out + [(item, *have) for item, have in open_.items()], answered


_BUILT: list = [None, None]  # a broadcast and its finder; a worker that is used again keeps both


def finder_of(shared) -> Finder:
    """The finder of a broadcast (items, words, answers), built once per worker process."""
    if _BUILT[0] is not shared:
        _BUILT[:] = shared, Finder(*shared.value)
    return _BUILT[1]


def bounded_items(items: DataFrame, max_item_chars: int) -> list:
    """Rows (item_id, item_text, answer) with a text, after a check of their size."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    wanted = items.select("item_id", "item_text", answer.alias("answer")).where(F.col("item_text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    size = wanted.agg(F.sum(F.length("item_text") + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    if size > max_item_chars:
        raise ValueError(f"the test items have {size} characters, more than max_item_chars={max_item_chars}")
    return wanted.collect()


def find_leaks(documents: DataFrame, items: DataFrame, words: int = RUN_WORDS, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, first_char, last_char, words, with_answer) of each passage that a document shares with an item."""
    rows = bounded_items(items, max_item_chars)
    shared = documents.sparkSession.sparkContext.broadcast(([(r.item_id, r.item_text) for r in rows], words, [(r.item_id, r.answer) for r in rows if r.answer]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = finder_of(shared)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                found, answered = finder.passages(text)
                if found:  # only texts with a hit need the map of offsets
                    spans = [m.span() for m in WORD.finditer(text)]
                    rows += [(doc_id, item, spans[a][0], spans[z - 1][1], z - a, item in answered) for item, a, z in found]
            yield pd.DataFrame(rows, columns=HITS_NAMES).astype(dict.fromkeys(HITS_NAMES[:-1], "int64"))

    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return texts.mapInPandas(scan, HITS).dropDuplicates(["doc_id", "item_id", "first_char", "last_char"])


def leaked_items(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Per benchmark: its items, those that leaked, and the documents that hold any of them."""
    named = items.select("item_id", "benchmark").distinct()
    hit = leaks.join(named, "item_id").groupBy("benchmark").agg(
        F.countDistinct("item_id").alias("leaked_items"), F.countDistinct("doc_id").alias("documents")
    )
    return (
        named.groupBy("benchmark").agg(F.countDistinct("item_id").alias("items"))
        .join(hit, "benchmark", "left")
        .select("benchmark", "items", F.coalesce("leaked_items", F.lit(0).cast("long")).alias("leaked_items"), F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))
    )
