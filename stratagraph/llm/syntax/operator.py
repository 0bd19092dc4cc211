"""Source files that do not parse.

``check_files`` judges every file by table-driven parsers for the language its path stands for. Results:
a null content, a path of another kind, or a null path gives no row; an empty text is a sentence of C, Python
and fragments and not of JSON and devicetree; redelivered rows give one row per (file_id, source_file);
very long texts are parsed whole. Only the bundled tables decide; every branch of a C or devicetree conditional that some
setting of its switches reaches is parsed. The error's text is its whole line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import check

RESULT = "file_id long, source_file string, repo string, language string, error_line int, error_text string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, path, repo, text in zip(batch.file_id, batch.source_file, batch.repo, batch.content):
            language = check.language_of(path)
            if language is None or text is None:
                continue
            at = check.first_error(language, text)
            if at < 0:
                rows.append((file_id, path, repo, language, None, None))
            else:
                text = text.replace("\r\n", "\n") if language in ("c", "devicetree") else text
                line = text.count("\n", 0, at) + 1
                begin = text.rfind("\n", 0, at) + 1
                end = text.find("\n", at)
                rows.append((file_id, path, repo, language, line, text[begin : end if end >= 0 else len(text)]))
        out = pd.DataFrame(rows, columns=["file_id", "source_file", "repo", "language", "error_line", "error_text"])
        yield out.astype({"file_id": "Int64", "error_line": "Int32"})


def check_files(files: DataFrame) -> DataFrame:
    """One row per judged file: its language and the line of its first unrecoverable error, null if there is none."""
    name = F.substring_index(F.replace(F.col("source_file"), F.lit("\\"), F.lit("/")), "/", -1)
    judged = name.rlike(r"(?:\.(?:py|c|h|dts|dtsi|overlay|conf|yaml|json)|_defconfig)$") | name.rlike(r"^Kconfig(?:\..*)?$")
    return (
        files.select("file_id", "source_file", "repo", "content")
        .where(F.col("content").isNotNull() & judged)
        .mapInPandas(_judge, RESULT)
        .dropDuplicates(["file_id", "source_file"])
    )


def invalid_rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    bad = F.count(F.col("error_line"))
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("files"), bad.alias("invalid_files"), F.round(bad / F.count("*"), 6).alias("rate")
    )
