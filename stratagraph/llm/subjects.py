"""Subject areas of each document, by label propagation over a verified similarity graph.

A document may deal with several subjects, so the graph links the passages (sentences) of documents, not whole
documents; a document gets every subject that at least ``SHARE`` of its passages deal with.

* Nodes: the content of a passage is its bursty words, those that come back in a document more often than chance
  allows (residual inverse document frequency, taken in the language where the word is most frequent, at least
  ``BURST``). Phrases that every document may have, names and stop words are not bursty. Passages with equal content
  are one node.
* Edges: all pairs of nodes whose contents have an exact Jaccard similarity of ``SIMILAR`` or more. Nodes lie in
  blocks of about ``BLOCK``; every pair of blocks is one task, which counts shared words by an inverted index of one of
  them. So nothing is left out, and work grows with the square of the nodes; a task holds two blocks.
* Propagation: human labels are the seeds. A node keeps its seed mass in every round and adds the distributions of
  its neighbours, by DataFrame joins, until fewer than ``SETTLED`` of the nodes change their subject, or for
  ``MAX_ROUNDS``. Documents whose annotators agree (at least two) are clamped: they come out with their labels.

Passages with ``QUOTED`` of their words inside a passage of a test item (runs of 12 words, found by the automaton of
``leak``) count neither for a subject nor as passages.

Defined results: null, empty and blank texts have no passage and no subject; labels are read without case and
surrounding blanks, labels outside the subject areas (and ``none``) name no subject; repeated labels of one annotator
count once; a repeated document row weighs twice and changes no share; documents without a language make up a
language of their own. Passages are known by 96 bits of hash, nodes by 128.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, trim_blank
from . import leak

BURST, SIMILAR = 0.22, 1 / 3
LIFT, SHARE, SMOOTH = 0.3, 0.25, 1.0
MAX_ROUNDS, SETTLED = 8, 0.002
QUOTED = 0.4
BROADCAST_WORDS = 100_000  # words and one hash of each
BROADCAST_NODES = 400_000  # one row of numbers a node; beyond that a shuffle join, with the same rows
BLOCK = 16_384
FLUSH_PAIRS = 1 << 21  # pairs that a task holds before it gives them out
MAX_SUBJECTS = 64  # the state of a node has one column a subject
NONE = "none"

_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_EDGE = " .,;:!?()[]{}\"'-*#>_`“”…–"


def sentences(text: str) -> list[str]:
    return [s for s in _BREAK.split(text) if any(ch.isalnum() for ch in s)]


class _Words(dict):
    """Token -> its word, or nothing for words of less than three letters and anything with digits or signs inside."""

    def __missing__(self, token: str) -> str:
        if len(self) > 1 << 18:  # tokens come back, but their number has no bound
            self.clear()
        w = token.strip(_EDGE).lower()
        self[token] = w = w if len(w) > 2 and w.isalpha() else ""
        return w


_WORDS = _Words()


def sentence_words(sentence: str) -> set[str]:
    """The distinct words of a sentence."""
    found = set(map(_WORDS.__getitem__, sentence.split()))
    found.discard("")
    return found


def _unquoted(text: str, passages: list[tuple[int, int, int]]) -> list[str]:
    """The sentences of a text but those that quote an item."""
    spans = [m.span() for m in leak.WORD.finditer(text)]
    inside = [False] * len(spans)
    for _, a, z in passages:
        inside[a:z] = [True] * (z - a)
    out, at, k = [], 0, 0
    for s in sentences(text):
        a = text.index(s, at)
        at = a + len(s)
        while k < len(spans) and spans[k][0] < a:
            k += 1
        own = k
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k == own or sum(inside[own:k]) < QUOTED * (k - own):
            out.append(s)
    return out


_SPLIT = "doc_id long, lang string, keys array<string>, uses array<long>, docs array<long>, n long"


def split_documents(documents: DataFrame, items: DataFrame | None, max_item_chars: int = leak.MAX_ITEM_CHARS) -> DataFrame:
    """Rows of documents, (doc_id, keys of the sentences), and of partial counts, (null, lang, words, their uses and documents, documents)."""
    rows = leak.bounded_items(items, max_item_chars) if items is not None else []
    shared = documents.sparkSession.sparkContext.broadcast(([(r.item_id, r.item_text) for r in rows], leak.RUN_WORDS))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = leak.finder_of(shared)
        for batch in batches:
            out: list[tuple] = []
            uses: dict[str, list[str]] = {}
            docs: dict[str, list[str]] = {}
            sizes: Counter = Counter()
            for doc_id, lang, text in zip(batch.doc_id, batch.lang, batch.text):
                quotes, _ = finder.passages(text)
                words = [sentence_words(s) for s in (_unquoted(text, quotes) if quotes else sentences(text))]
                out.append((doc_id, lang, [" ".join(sorted(w)) for w in words], None, None, None))
                if words:
                    uses.setdefault(lang, []).extend(chain.from_iterable(words))
                    docs.setdefault(lang, []).extend(set().union(*words))
                    sizes[lang] += 1
            for lang, said in uses.items():
                count, held = Counter(said), Counter(docs[lang])
                out.append((None, lang, list(count), list(count.values()), [held[w] for w in count], sizes[lang]))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "keys", "uses", "docs", "n"]).astype({"doc_id": "Int64", "n": "Int64"})

    lang = F.lower(trim_blank(F.col("lang"))) if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.select("doc_id", F.coalesce(F.regexp_extract(lang, "^[a-z]{2}", 0), F.lit("")).alias("lang"), "text")
    return texts.where("text is not null and doc_id is not null").mapInPandas(split, _SPLIT)


def bursty_words(counts: DataFrame, least: float = BURST) -> DataFrame:
    """(word): the words whose uses lie in fewer documents than chance spreads them over."""
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("size"))  # one row a language, by two letters
    rows = counts.select("lang", F.explode(F.arrays_zip("keys", "uses", "docs")).alias("w")).groupBy(F.col("w.keys").alias("word"), "lang").agg(F.sum("w.uses").alias("uses"), F.sum("w.docs").alias("docs"))
    rows = rows.join(F.broadcast(sizes), "lang")
    main = rows.groupBy("word").agg(F.max(F.struct(F.col("lang") != "", F.col("uses") / F.col("size"), "uses", "docs", "size")).alias("m")).select("word", "m.uses", "m.docs", "m.size")
    chance = F.col("size") * (1 - F.exp(-F.col("uses") / F.col("size")))
    return main.where(F.log(chance / F.col("docs")) >= least).select("word")


def seeds(labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, subject, weight, trusted): the labels' shares per document; trusted where all annotators (at least two) agree."""
    said = labels.select("doc_id", F.lower(trim_blank(F.col("subject"))).alias("subject"), "annotator")
    said = said.where(F.col("subject").isin([*names, NONE]) & F.col("doc_id").isNotNull()).distinct()
    by = said.groupBy("doc_id", "subject").agg(F.countDistinct("annotator").alias("votes"))
    every = Window.partitionBy("doc_id")  # at most one row per subject area
    heads = said.groupBy("doc_id").agg(F.countDistinct("annotator").alias("heads"))
    by = by.join(heads, "doc_id").withColumn("weight", F.col("votes") / F.sum("votes").over(every))
    return by.withColumn("trusted", (F.min("votes").over(every) == F.col("heads")) & (F.col("heads") > 1)).select("doc_id", "subject", "weight", "trusted")


_PLACE = 33  # a node's number is its block, shifted by as many bits, and its place there (monotonically_increasing_id)
_PACKED = "dst long, base long, srcs array<int>"


def least_shared(most: int) -> np.ndarray:
    """For every sum of two sizes up to ``most``, how many words two sets must share to be similar."""
    both = np.arange(most + 1)
    least = np.floor(SIMILAR * both / (1 + SIMILAR)).astype(np.int64)
    return least + (least < SIMILAR * (both - least))


def _rows(dst: np.ndarray, base: int, sizes: np.ndarray, srcs: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(srcs.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(dst.astype(np.int64)), pa.array(np.full(len(dst), base, np.int64)), lists], names=["dst", "base", "srcs"])


def _similar(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All similar pairs between two blocks of nodes (or inside one), in both directions."""
    i, j = (k.as_py() for k in key)
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    cores, lists = rows["core"].to_numpy(), rows["words"].combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    _, words = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    place = cores & ((1 << _PLACE) - 1)
    left, right = (np.flatnonzero(cores >> _PLACE == k) for k in (i, j))
    # inverted index of the right block: its nodes by word
    at = np.full(len(cores), -1)
    at[right] = np.arange(len(right))
    holder = at[np.repeat(np.arange(len(cores)), sizes)]
    order = np.flatnonzero(holder >= 0)
    order = order[np.argsort(words[order], kind="stable")]
    nodes, bounds = holder[order], np.searchsorted(words[order], np.arange(words.max() + 2))

    least, counter = least_shared(2 * int(sizes.max())), np.min_scalar_type(int(sizes.max()))
    found: list[tuple[int, np.ndarray]] = []
    held, size, need = 0, -1, None
    for x in left[np.argsort(sizes[left], kind="stable")].tolist():
        if sizes[x] != size:
            size = sizes[x]
            need = least[size + sizes[right]].astype(counter)
        shared = np.zeros(len(right), counter)
        for w in words[starts[x] : starts[x + 1]].tolist():
            shared[nodes[bounds[w] : bounds[w + 1]]] += 1
        near = np.flatnonzero(shared >= need)
        if i == j:
            near = near[near > at[x]]
        if len(near):
            found.append((x, near))
            held += len(near)
        if held >= FLUSH_PAIRS:
            yield from _both_ways(found, i, j, cores, place, right)
            found, held = [], 0
    yield from _both_ways(found, i, j, cores, place, right)


def _both_ways(found: list[tuple[int, np.ndarray]], i: int, j: int, cores: np.ndarray, place: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    xs, n = np.array([x for x, _ in found]), np.array([len(near) for _, near in found])
    ys = np.concatenate([near for _, near in found])
    yield _rows(cores[xs], j << _PLACE, n, place[right[ys]])
    order = np.argsort(ys, kind="stable")
    back, m = np.unique(ys, return_counts=True)
    yield _rows(cores[right[back]], i << _PLACE, m, place[np.repeat(xs, n)[order]])


def packed_graph(keys: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: core; members: a, b -> core; packed: dst, base, srcs) of distinct sentences ``keys`` (a, b, key): dst is linked to every base + src."""
    word = F.explode(F.split("key", " ")).alias("word")
    content = content.select("word", F.xxhash64("word").alias("w"), F.xxhash64("word", F.lit(0)).alias("h"))
    if content.count() <= BROADCAST_WORDS:  # beyond that a shuffle join, with the same rows
        content = F.broadcast(content)
    # the content of a sentence: two independent hashes of the set
    held = keys.select("a", "b", word).join(content, "word")
    own = cut(held.groupBy("a", "b").agg(F.bit_xor("w").alias("x"), F.bit_xor("h").alias("y"), F.count("*").alias("size")))
    cores = cut(own.groupBy("x", "y", "size").agg(F.min(F.struct("a", "b")).alias("one")))
    blocks = max(-(-cores.count() // BLOCK), 1)
    cores = cut(cores.repartition(blocks).withColumn("core", F.monotonically_increasing_id()))  # fixed by being written
    members = own.select("a", "b", "x", "y", "size").join(cores.select("x", "y", "size", "core"), ["x", "y", "size"]).select("a", "b", "core")

    sets = cores.select("core", F.col("one.a").alias("a"), F.col("one.b").alias("b")).join(keys.select("a", "b", "key"), ["a", "b"])
    sets = sets.select("core", word).join(content, "word").groupBy("core").agg(F.collect_list("w").alias("words"))  # the words of one sentence
    block, other = F.shiftright("core", _PLACE), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    met = sets.select("core", "words", other).select("core", "words", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"))
    return cores.select("core"), members, met.groupBy("i", "j").applyInArrow(_similar, _PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """(src, dst) of every link, in both directions."""
    return packed.select("dst", "base", F.explode("srcs").alias("place")).select((F.col("base") + F.col("place")).alias("src"), "dst")


def passage_graph(keys: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: core; members: a, b -> core; links: src, dst in both directions) of distinct sentences ``keys`` (a, b, key)."""
    nodes, members, packed = packed_graph(keys, content)
    return nodes, members, unpacked(packed)


def spread(nodes: DataFrame, links: DataFrame, mass: DataFrame, names: list[str]) -> DataFrame:
    """(core, subject): the subject of every node that has one, from seed mass (core, subject, mass)."""
    every = [*names, NONE]
    k = range(len(every))
    y = mass.groupBy("core").agg(*(F.sum(F.when(F.col("subject") == s, F.col("mass")).otherwise(0.0)).alias(f"y{i}") for i, s in enumerate(every)))
    y = cut(y)
    whole = y.agg(*(F.sum(f"y{i}") for i in k)).first()  # one number a subject
    prior = [x or 0.0 for x in whole]
    prior = [x / (sum(prior) or 1.0) for x in prior]

    def settle(df: DataFrame, f: list[Column], *keep: str) -> DataFrame:
        """Distribution and subject of each node from its mass f."""
        df = df.select("core", *keep, *(c.alias(f"f{i}") for i, c in enumerate(f)))
        total = sum((F.col(f"f{i}") for i in k), F.lit(0.0))
        df = df.withColumn("total", total)
        lift = [((F.col(f"f{i}") + SMOOTH * prior[i]) / (F.col("total") + SMOOTH) - prior[i]) / max(1 - prior[i], 1e-9) for i in range(len(names))]
        best = F.array_max(F.array(*(F.struct(x.alias("lift"), F.lit(-i).alias("order")) for i, x in enumerate(lift))))
        subject = F.when((F.col("total") > 0) & (best["lift"] >= LIFT), -best["order"]).otherwise(-1)
        return df.select("core", *keep, *(F.when(F.col("total") > 0, F.col(f"f{i}") / F.col("total")).otherwise(0.0).alias(f"p{i}") for i in k), subject.alias("best"))

    ys = [f"y{i}" for i in k]
    state = nodes.join(y, "core", "left").na.fill(0.0, ys)
    state = cut(settle(state, [F.col(c) for c in ys], *ys))
    n = state.count()
    small = F.broadcast if n <= BROADCAST_NODES else lambda df: df
    for _ in range(MAX_ROUNDS):
        told = state.where(" + ".join(f"p{i}" for i in k) + " > 0").select(F.col("core").alias("src"), *(f"p{i}" for i in k))
        heard = links.join(small(told), "src").groupBy(F.col("dst").alias("core")).agg(*(F.sum(f"p{i}").alias(f"g{i}") for i in k))
        after = state.select("core", *ys, F.col("best").alias("was")).join(heard, "core", "left").na.fill(0.0, [f"g{i}" for i in k])
        state = cut(settle(after, [F.col(f"y{i}") + F.col(f"g{i}") for i in k], *ys, "was"))
        if state.where("best <> was").count() <= SETTLED * n:
            break
    said = F.array(*map(F.lit, names))
    return state.where("best >= 0").select("core", F.get(said, F.col("best")).alias("subject"))


def propagate(split: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, subject, n, total): passages of every document per subject, and all its passages."""
    seeded = seeds(labels, names).select("doc_id", "subject", "weight")
    known = lambda key: F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))
    docs = split.where("doc_id is not null").select("doc_id", "keys")
    ids = docs.select("doc_id", F.transform("keys", known).alias("ids"))
    keys = cut(docs.select(F.explode("keys").alias("key")).distinct().select(known(F.col("key")).alias("k"), "key").select("k.a", "k.b", "key"))
    content = cut(bursty_words(split.where("doc_id is null")))
    nodes, members, packed = packed_graph(keys, content)
    packed = packed.persist()  # read in every round
    # a sentence that very many documents have is a large group of this join; adaptive execution splits it
    placed = cut(ids.select("doc_id", F.explode("ids").alias("k")).select("doc_id", "k.a", "k.b").join(members, ["a", "b"]).groupBy("doc_id", "core").agg(F.count("*").alias("n")))
    mass = placed.join(seeded, "doc_id").groupBy("core", "subject").agg(F.sum(F.col("n") * F.col("weight")).alias("mass"))
    about = spread(nodes, unpacked(packed), mass, names)  # its rows are written when it comes back
    packed.unpersist()
    counted = placed.join(about, "core").groupBy("doc_id", "subject").agg(F.sum("n").alias("n"))
    total = docs.groupBy("doc_id").agg(F.sum(F.size("keys")).alias("total"))
    return counted.join(total, "doc_id")


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share) for every document and subject with at least that share of the passages, and of trusted labels."""
    found = areas.select("subject").where("subject is not null").distinct().limit(MAX_SUBJECTS + 1).collect()
    if len(found) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subject areas")
    spelled = {r.subject.strip().lower(): r.subject for r in found}
    names = sorted(spelled)
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    split = cut(split_documents(documents, items))
    counted = cut(propagate(split, labels, names).withColumn("share", F.col("n") / F.col("total")).select("doc_id", "subject", "share"))
    sure = cut(seeds(labels, names).where("trusted").select("doc_id", "subject"))
    sure = sure.join(split.where("doc_id is not null and size(keys) > 0").select("doc_id").distinct(), "doc_id", "left_semi")
    free = counted.where(F.col("share") >= share).join(sure.select("doc_id").distinct(), "doc_id", "left_anti")
    held = sure.where(F.col("subject") != NONE).join(counted, ["doc_id", "subject"], "left").na.fill(0.0, ["share"])
    named = F.create_map(*(F.lit(x) for pair in spelled.items() for x in pair))
    return free.unionByName(held).select("doc_id", named[F.col("subject")].alias("subject"), "share")


def composition(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the documents that deal with each subject, per source and language (spelling variants united)."""
    source = F.lower(trim_blank(F.col("source"))).alias("source")
    lang = F.substring_index(F.lower(trim_blank(F.col("lang"))), "-", 1).alias("lang")
    docs = documents.select("doc_id", source, lang).dropDuplicates(["doc_id"])
    size = docs.groupBy("source", "lang").agg(F.count("*").alias("documents"))
    by = docs.join(found.select("doc_id", "subject"), "doc_id").groupBy("source", "lang", "subject").agg(F.count("*").alias("n"))
    same = F.expr("source <=> s and lang <=> l")
    return by.join(size.withColumnsRenamed({"source": "s", "lang": "l"}), same).select("source", "lang", "subject", "n", "documents", F.round(F.col("n") / F.col("documents"), 6).alias("share"))
