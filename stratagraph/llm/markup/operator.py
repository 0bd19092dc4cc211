"""Markup residue in text documents.

Every leaf of a text is labelled by the trained bidirectional LSTM (``lstm``), reading the path of open elements and
hashed shapes of words, with the whole text as context; clean text and blocks follow from the labels. A text is a case
if a leaf has a label of markup and an exact check finds the sign of it.

Defined results: null and blank texts, and texts without an id, are no case; repeated rows count once per id; texts are read
whole, as one sequence of leaves, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean, lstm
from .leaves import features, is_long, leaves, pieces, without_marks

CLEANED = "tab string, row_id long, marked boolean, signs array<string>, text string, blocks array<struct<kind: string, text: string>>"
_TEXT = clean.NAMES["text"]


@cache
def weights() -> dict[str, np.ndarray]:
    with np.load(Path(__file__).with_name("weights.npz")) as z:
        return {k: z[k].astype("float32") for k in z.files}


def label(texts: list[str]) -> list[np.ndarray]:
    """The most likely label of every leaf of every text. A long leaf that looks plain is read again in pieces, and is plain only if all of them are."""
    sequences = [features(t) for t in texts]
    out = lstm.classify(weights(), sequences)
    again, spans = [], []
    for i, (t, labels) in enumerate(zip(texts, out)):
        if not (labels == _TEXT).any() or not is_long(t):  # a text without a long line or token has no long leaf
            continue
        rows = leaves(t)
        if not (cut := [k for k in np.flatnonzero(labels == _TEXT) if is_long(rows[k][0])]):
            continue
        sequence, at = [], 0
        for k in cut:
            sequence += sequences[i][at:k]
            spans.append((len(again), len(sequence), len(sequence) + len(p := pieces(*rows[k])), i, k))
            sequence += p
            at = k + 1
        again.append(sequence + sequences[i][at:])
    got = lstm.classify(weights(), again)
    for n, a, z, i, k in spans:
        if (marked := got[n][a:z][got[n][a:z] != _TEXT]).size:
            out[i][k] = marked[0]
    return out


def signs(rows, labels) -> list[str]:
    """Signs of markup in the leaves whose label says markup."""
    found: dict[str, None] = {}
    for i in np.flatnonzero(labels != _TEXT):
        line, path, _ = rows[i]
        before = rows[i - 1][0] if i else ""
        after = rows[i + 1][0] if i + 1 < len(rows) else ""
        found |= dict.fromkeys(clean.evidence(line, before, after, path))
    return list(found)


def settled(rows, labels) -> np.ndarray:
    """Labels for rendering: a leaf without any sign of markup is plain after all."""
    out = labels.copy()
    for i in np.flatnonzero(labels != _TEXT):
        before = rows[i - 1][0] if i else ""
        after = rows[i + 1][0] if i + 1 < len(rows) else ""
        if not clean.evidence(rows[i][0], before, after, rows[i][1]):
            out[i] = _TEXT
    return out


def _run(render: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [without_marks(t, m) if tab == "entities" else t.replace("\r\n", "\n").replace("\r", "\n") for tab, m, t in zip(batch["tab"], batch["method"], batch["text"])]
            out = []
            for tab, row, text, labels in zip(batch["tab"], batch["row_id"], texts, label(texts)):
                if not render and not (labels != _TEXT).any():
                    continue
                rows = leaves(text)
                found = signs(rows, labels)
                if render:
                    body, blocks = clean.render(rows, settled(rows, labels)) if found else ("\n".join(text.split("\n")).strip(), [])
                    out.append((tab, row, bool(found), found, body, [{"kind": k, "text": s} for k, s in blocks]))
                elif found:
                    out.append((tab, row, True, found, None, None))
            yield pd.DataFrame(out, columns=["tab", "row_id", "marked", "signs", "text", "blocks"])

    return run


def texts_of(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(tab, row_id, method, text): sections of text documents, and descriptions."""
    none = F.lit(None).cast("string")
    a = chunks.where("chunk_type = 'section'").select(F.lit("source_chunks").alias("tab"), F.col("chunk_id").alias("row_id"), none.alias("method"), F.col("content").alias("text"))
    b = entities.select(F.lit("entities").alias("tab"), F.col("entity_id").alias("row_id"), F.col("extraction_method").alias("method"), F.col("description").alias("text"))
    return a.unionByName(b).where((F.trim("text") != "") & F.col("row_id").isNotNull())


def clean_texts(texts: DataFrame, render: bool = True) -> DataFrame:
    """Every text with its clean form and blocks; without ``render`` only the texts with markup, and their signs."""
    return texts.select("tab", "row_id", "method", "text").mapInPandas(_run(render), CLEANED).dropDuplicates(["tab", "row_id"])
