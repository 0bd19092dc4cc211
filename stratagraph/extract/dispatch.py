"""Which extractor reads a file, and the operator that runs them over a table of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import c_, config_, python_, text_
from .records import COLUMNS, SHAPE, Emitter

EXTRACTORS: dict[str, Callable[[str, str], Emitter]] = {
    "python": python_.extract,
    "c": lambda p, t: c_.extract(p, t, "c"),
    "cpp": lambda p, t: c_.extract(p, t, "cpp"),
    "kconfig-decl": config_.kconfig,
    "kconfig-fragment": config_.fragment,
    "devicetree": config_.devicetree,
    "dt-binding-yaml": config_.binding,
    "rst": text_.rst,
    "markdown": text_.markdown,
}


def register_extractor(language: str, extract: Callable[[str, str], Emitter]) -> None:
    """Adds or replaces the extractor of a language."""
    EXTRACTORS[language] = extract


def extract_file(path: str, language: str, text: str, extractors: dict | None = None) -> list[tuple]:
    handler = (EXTRACTORS if extractors is None else extractors).get(language)
    if handler is None:
        return []
    try:
        return handler(path, text).rows
    except Exception as e:  # one bad file must not stop the others
        out = Emitter(path, "")
        out.ambiguity(path, "SourceFile", 1, f"parser error: {type(e).__name__}")
        return out.rows


def _runner(extractors: dict[str, Callable[[str, str], Emitter]]):
    """The extractors travel with the task, so those registered on the driver are known to all workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ints = ["seq", "line_start", "line_end", "line", "win_start", "win_end"]
        for batch in batches:
            rows = [r for p, lang, t in zip(batch.source_file, batch.language, batch.content) for r in extract_file(p, lang, t, extractors)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype(dict.fromkeys(ints, "Int32"))

    return run


def extract(files: DataFrame) -> DataFrame:
    """Tagged rows of every file with a known language; files without text or extractor give none.

    The filter on the language comes first, so only texts an extractor reads go to Python.
    """
    known = files.select("source_file", "language", "content").where(F.col("content").isNotNull() & F.col("language").isin(*EXTRACTORS))
    return known.mapInPandas(_runner(dict(EXTRACTORS)), SHAPE)
