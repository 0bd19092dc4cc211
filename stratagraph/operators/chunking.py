"""Evidence chunks: fixed windows of lines, their uids, and the way from a line to its chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

WINDOW = 200


def chunk_uid(source_file: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("SourceChunk|"), source_file, F.lit("|"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("|"), text.digest(content, 16))


def chunks(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, source_file, line_start, line_end, content, chunk_type): consecutive windows, made inside the row, without a shuffle.

    Files without text (null content) give none; an empty file gives one chunk of line 1 with empty content.
    """
    lines = files.where("content is not null").select("source_file", text.split_lines(F.col("content")).alias("lines"))
    n = F.size("lines")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(window))
    part = lambda i: F.struct((i + 1).alias("line_start"), F.greatest(F.least(i + window, n), F.lit(1)).alias("line_end"), F.array_join(F.slice("lines", i + 1, F.lit(window)), "").alias("content"))
    rows = lines.select("source_file", F.explode(F.transform(starts, part)).alias("c")).select("source_file", "c.*")
    uid = chunk_uid(F.col("source_file"), F.col("line_start"), F.col("line_end"), F.col("content"))
    return rows.select(uid.alias("uid"), "source_file", "line_start", "line_end", "content", F.lit("fixed_window").alias("chunk_type")).dropDuplicates(["uid"])


def chunk_of_line(rows: DataFrame, made: DataFrame, line: str = "line_start", window: int = WINDOW) -> DataFrame:
    """Adds source_chunk_uid: the fixed window a line lies in, by an equi-join on the window's number."""
    number = F.floor((F.col(line) - 1) / window)
    key = made.where("chunk_type = 'fixed_window'").select("source_file", F.floor((F.col("line_start") - 1) / window).alias("window_no"), F.col("uid").alias("source_chunk_uid"))
    return rows.withColumn("window_no", number).join(key, ["source_file", "window_no"], "left").drop("window_no")
