"""Splitting oversized items at natural boundaries.

Works on byte ranges: the bytes of an item are cut into ranges where its row is read (a cell of a table is in memory as
a whole by then; files are read range by range, by offset, with :func:`split_files`), and no later task needs a whole
item. A range is decoded
with a halo of a few bytes on either side, counted, and searched for boundaries. Prefix sums over the counts (not over
the text) turn positions inside ranges into positions in the item. Boundaries are thinned to the best one per cell (an
eighth of a piece), the cells of an item are grouped into segments of bounded size that start at a cut of their own,
and the cuts of each segment are chosen independently. Pieces are then assembled from the ranges they touch.

A piece has at most ``max_chars`` characters, its overlap included, and starts with the last ``overlap_chars``
characters of the piece before. Cuts prefer the start of a paragraph, a heading or what follows a definition, then of a
line, the end of a sentence, and white space, and take the farthest of the best within reach; only text without any of these is cut elsewhere, and
never inside a CR LF pair.

Defined results: a null chunk_type means ``fixed_window``; chunks of a type without limits, with null content, without
an id, or within their limit give no piece; repeated rows give one set of pieces; line numbers are counted from line_start
(null: 1) by line feeds, whatever line_end says. An overlap of half the limit or more is an error in the limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut

RANGE_BYTES = 1 << 17
HALO = 16
CELLS = 8
SEGMENT_CELLS = 2048
DEFAULT_TYPE = "fixed_window"

_RANGE = "chunk_id long, version long, range_no long, lead string, text string, chars long, lines long"
_BEST = "chunk_id long, cell long, score long, pos long"
_CUTS = "chunk_id long, start long, stop long"
_BREAKS = (  # later ones are stronger
    (1, re.compile(r"\s(?=\S)")),
    (2, re.compile(r"(?<=[.!?;:])\s+(?=\S)")),
    (3, re.compile(r"\n|\r(?!\n)")),
    (4, re.compile(r"(?:\n|\r\n?)[ \t]*(?:\r\n|\n|\r)(?!\s*(?:\r|\n))|(?:\n|\r(?!\n))(?=#{1,6} \S|={1,6} ?\S|\\(?:chapter|(?:sub)*section)\b|<h[1-6]\b)|(?<=[\n\r]\})(?:\r\n|\n|\r)(?=[^\s{}])")),  # an empty line, a heading, the end of a definition
)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, version, line_start, content, max_chars, overlap_chars) of the rows over their limit; version tells texts of one id apart."""
    limits = limits.select(F.col("chunk_type").alias("kind"), "max_chars", "overlap_chars").where("chunk_type is not null and max_chars > 0").distinct()
    limits = limits.withColumn("overlap_chars", F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)))
    ok = F.when(F.col("overlap_chars") * 2 < F.col("max_chars"), F.col("max_chars")).otherwise(F.raise_error(F.lit("overlap_chars must be less than half of max_chars")))
    kind = F.coalesce("chunk_type", F.lit(DEFAULT_TYPE)).alias("kind")
    big = chunks.select("chunk_id", kind, F.coalesce("line_start", F.lit(1)).alias("line_start"), "content").join(limits, "kind").withColumn("max_chars", ok)
    big = big.where((F.length("content") > F.col("max_chars")) & F.col("chunk_id").isNotNull())
    return big.select("chunk_id", F.xxhash64("content").alias("version"), "line_start", "content", "max_chars", "overlap_chars")


def _ranges(big: DataFrame, size: int) -> DataFrame:
    """One row per byte range, with its halo; plain slices of the bytes, made where the row was read. Repeated rows give equal ranges, kept once."""
    raw = F.col("content").cast("binary")
    n = F.ceil(F.octet_length("content") / size) - 1
    # substring counts from 1; a range of number i > 0 starts HALO bytes early
    part = lambda i: F.struct(i.alias("range_no"), F.substring(raw, F.greatest(i * size - HALO + 1, F.lit(1)).cast("int"), F.lit(size + 2 * HALO)).alias("bytes"))
    rows = big.select("chunk_id", "version", F.explode(F.transform(F.sequence(F.lit(0), n.cast("int")), part)).alias("r"))
    rows = rows.select("chunk_id", "version", F.col("r.range_no").cast("long").alias("range_no"), "r.bytes")
    return rows.dropDuplicates(["chunk_id", "version", "range_no"])


def _file_ranges(files: DataFrame, size: int) -> DataFrame:
    """The same for whole files, (chunk_id, path, bytes): every range is read by its offset, and no task sees the file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for chunk, path, no in zip(batch.chunk_id, batch.path, batch.range_no):
                system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                with system.open_input_file(name) as f:
                    at = max(no * size - HALO, 0)
                    f.seek(at)
                    yield pd.DataFrame({"chunk_id": [chunk], "version": [0], "range_no": [no], "bytes": [f.read(size + 2 * HALO if no else size + HALO)]})

    n = F.greatest(F.ceil(F.col("bytes") / size) - 1, F.lit(0))
    numbered = files.select("chunk_id", "path", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("range_no"))
    numbered = numbered.repartition("chunk_id", "range_no")
    return numbered.mapInPandas(read, "chunk_id long, version long, range_no long, bytes binary")


def _decode(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, version, no, raw in zip(batch.chunk_id, batch.version, batch.range_no, batch.bytes):
                a = HALO if no else 0
                z = a + size
                while a < len(raw) and a > 0 and raw[a] & 0xC0 == 0x80:  # a character belongs to the range of its first byte
                    a += 1
                while z < len(raw) and raw[z] & 0xC0 == 0x80:
                    z += 1
                text = raw[a:z].decode("utf-8", "replace")
                lead = raw[max(0, a - HALO) : a].decode("utf-8", "ignore")[-8:]
                rows.append((chunk, version, no, lead, text, len(text), text.count("\n")))
            yield pd.DataFrame(rows, columns=["chunk_id", "version", "range_no", "lead", "text", "chars", "lines"])

    return run


def _boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best boundary of every cell, of those inside the range; a position is the first character after the cut."""
    for batch in batches:
        out = []
        for chunk, lead, text, at, step, total in zip(batch.chunk_id, batch.lead, batch.text, batch["at"], batch.cell_chars, batch.total):
            body, shift = lead + text, at - len(lead)
            best: dict[int, tuple[int, int]] = {}
            for score, pattern in _BREAKS:
                for m in pattern.finditer(body):
                    pos = m.end() + shift
                    if at <= pos < at + len(text) and 0 < pos < total:
                        best[pos // step] = max(best.get(pos // step, (0, 0)), (score, pos))
            for cell in range(at // step, (at + len(text) - 1) // step + 1):  # a cell without any: its last character
                if cell not in best:
                    pos = min((cell + 1) * step - 1, at + len(text) - 1, total - 1)
                    k = pos - shift
                    if 0 < k < len(body) and body[k - 1] == "\r" and body[k] == "\n":
                        pos -= 1
                    if pos > 0:
                        best[cell] = (0, pos)
            out += [(chunk, cell, s, p) for cell, (s, p) in best.items()]
        yield pd.DataFrame(out, columns=["chunk_id", "cell", "score", "pos"]).astype("int64")


def choose(pos: np.ndarray, score: np.ndarray, start: int, first: int, room: int, least: int) -> list[int]:
    """Cuts from the candidates after ``start``: within reach the best of the farther half, else the best of all.

    A piece brings at least ``least`` characters, so that the next one can repeat as many.
    """
    cuts, at, reach, n = [], start, first, len(pos)
    while True:
        j = int(np.searchsorted(pos, at + reach, "right"))
        if j >= n:
            return cuts
        i = int(np.searchsorted(pos, at + max(least, 1), "left"))
        lo = max(i, int(np.searchsorted(pos, at + reach // 2, "left")))
        if lo < j and (score[lo:j].max() > 0 or lo == i):
            i = lo
        if i >= j:  # no candidate in reach: only where cells are wider than pieces
            i, j = j, j + 1
        near = score[i:j]
        k = i + int(np.flatnonzero(near == near.max())[-1])
        at, reach = int(pos[k]), room
        cuts.append(at)


def _segment(cells, limit: int, overlap: int, total: int, segment: int) -> list[tuple[int, int]]:
    """The pieces of one segment: from its opening cut to that of the next segment, or the end of the item."""
    start = max((c["pos"] for c in cells if c["opens"]), default=0)
    stop = max((c["pos"] for c in cells if c["closes"]), default=total)
    own = sorted((c["pos"], c["score"]) for c in cells if not c["opens"] and start < c["pos"] < stop)
    pos, score = np.array([p for p, _ in own] + [stop]), np.array([s for _, s in own] + [9])
    room = limit - overlap
    cuts = choose(pos, score, start, limit if segment == 0 else room, room, overlap)
    edges = [start, *[c for c in cuts if c < stop], stop]
    if stop < total and len(edges) > 2 and stop - edges[-2] < overlap:  # the next segment repeats the end of this piece
        edges[-2] = stop - overlap
    return list(zip(edges, edges[1:]))


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for chunk, segment, limit, overlap, total, cells in zip(batch.chunk_id, batch.segment, batch.max_chars, batch.overlap_chars, batch.total, batch.cells):
            out += [(chunk, a, z) for a, z in _segment(cells, limit, overlap, total, segment) if z > a]
        yield pd.DataFrame(out, columns=["chunk_id", "start", "stop"]).astype("int64")


def split_oversized(chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(chunk_id, piece_no, line_start, line_end, content) of every chunk over its limit."""
    big = oversized(chunks, limits)
    one = F.min(F.struct("version", F.col("line_start").alias("first_line"), "max_chars", "overlap_chars", F.length("content").cast("long").alias("total"))).alias("f")
    facts = cut(big.groupBy("chunk_id").agg(one).select("chunk_id", "f.*"))  # numbers only
    return _assembled(cut(_ranges(big, range_bytes).mapInPandas(_decode(range_bytes), _RANGE)), facts, range_bytes)


def split_files(files: DataFrame, max_chars: int, overlap_chars: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same for files of UTF-8 text, (chunk_id, path, bytes: their size): ranges are read by offset, so a file may be of any size."""
    if overlap_chars < 0 or overlap_chars * 2 >= max_chars:
        raise ValueError("overlap_chars must be less than half of max_chars")
    ranges = cut(_file_ranges(files, range_bytes).mapInPandas(_decode(range_bytes), _RANGE))
    facts = ranges.groupBy("chunk_id").agg(F.sum("chars").alias("total")).where(F.col("total") > max_chars)
    facts = facts.select("chunk_id", F.lit(0).cast("long").alias("version"), F.lit(1).alias("first_line"), F.lit(max_chars).alias("max_chars"), F.lit(overlap_chars).alias("overlap_chars"), "total")
    return _assembled(ranges, cut(facts), range_bytes)


def _assembled(ranges: DataFrame, facts: DataFrame, range_bytes: int) -> DataFrame:
    """Pieces from decoded ranges and the facts of their items."""
    facts = facts.withColumn("cell_chars", F.greatest(F.floor((F.col("max_chars") - F.col("overlap_chars")) / CELLS), F.lit(1)).cast("long"))
    before = Window.partitionBy("chunk_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # numbers only
    counts = ranges.select("chunk_id", "version", "range_no", "chars", "lines").join(facts.select("chunk_id", "version"), ["chunk_id", "version"])
    sums = counts.select("chunk_id", "version", "range_no", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("line_at"))
    placed = cut(ranges.join(sums, ["chunk_id", "version", "range_no"]).join(facts.drop("version"), "chunk_id").where("chars > 0"))

    best = placed.select("chunk_id", "lead", "text", "at", "cell_chars", "total").mapInPandas(_boundaries, _BEST)
    best = best.groupBy("chunk_id", "cell").agg(F.max(F.struct("score", "pos")).alias("b")).select("chunk_id", "cell", "b.score", "b.pos")
    best = best.join(facts.select("chunk_id", "max_chars", "overlap_chars", "total"), "chunk_id")
    last = F.col("cell") % SEGMENT_CELLS == SEGMENT_CELLS - 1
    own = F.floor(F.col("cell") / SEGMENT_CELLS)
    rows = F.array(F.struct(own.alias("segment"), F.lit(0).alias("opens"), last.cast("int").alias("closes")), F.when(last, F.struct((own + 1).alias("segment"), F.lit(1).alias("opens"), F.lit(0).alias("closes"))))
    rows = best.select("*", F.explode(rows).alias("e")).where("e is not null").select("chunk_id", "e.segment", "pos", "score", "max_chars", "overlap_chars", "total", "e.opens", "e.closes")
    cells = F.collect_list(F.struct("pos", "score", "opens", "closes")).alias("cells")  # at most SEGMENT_CELLS + 1
    cuts = rows.groupBy("chunk_id", "segment", "max_chars", "overlap_chars", "total").agg(cells).mapInPandas(_cuts, _CUTS)
    number = F.row_number().over(Window.partitionBy("chunk_id").orderBy("start"))  # numbers only
    cuts = cuts.withColumn("piece_no", number - 1).join(facts.select("chunk_id", "overlap_chars"), "chunk_id")
    pieces = cuts.select("chunk_id", "piece_no", F.greatest(F.col("start") - F.when(F.col("piece_no") > 0, F.col("overlap_chars")).otherwise(0), F.lit(0)).alias("a"), F.col("stop").alias("z"))

    # a piece and a range that overlap meet in exactly one bucket of positions
    bucket = lambda a, z: F.sequence(F.floor(a / range_bytes), F.floor((z - 1) / range_bytes))
    left = pieces.withColumn("b", F.explode(bucket(F.col("a"), F.col("z"))))
    right = placed.withColumn("end", F.col("at") + F.col("chars")).withColumn("b", F.explode(bucket(F.col("at"), F.col("end"))))
    met = left.join(right, ["chunk_id", "b"]).where("a < end and at < z").where(F.floor(F.greatest("a", "at") / range_bytes) == F.col("b"))
    lo, hi = F.greatest("a", "at"), F.least("z", "end")
    part = F.substring("text", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int"))
    head = F.substring("text", F.lit(1), (lo - F.col("at")).cast("int"))
    feeds = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    parts = met.select("chunk_id", "piece_no", F.struct("at", part.alias("part"), (F.col("first_line") + F.col("line_at") + feeds).alias("line")).alias("p"))
    whole = parts.groupBy("chunk_id", "piece_no").agg(F.sort_array(F.collect_list("p")).alias("p"))  # the ranges of one piece
    content = F.array_join("p.part", "")
    first = F.col("p")[0]["line"]
    inner = F.regexp_replace(content, r"\n\z", "")
    return whole.select("chunk_id", F.col("piece_no").cast("int").alias("piece_no"), first.cast("int").alias("line_start"), (first + F.length(inner) - F.length(F.replace(inner, F.lit("\n"), F.lit("")))).cast("int").alias("line_end"), content.alias("content"))
