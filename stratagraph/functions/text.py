"""Scalar functions on text, inside the JVM unless the name says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the line ends that splitting into lines honours, as character classes of Java and RE2 patterns.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
NOT_LINE_END = "[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def split_lines(text: Column) -> Column:
    """Lines with their ends; a text that ends with a line end has no empty line after it, an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_LINE_END}*(?:{LINE_END})|{NOT_LINE_END}+"), F.lit(0))


def line_count(text: Column, binary: Column | None = None) -> Column:
    """Line feeds plus one; 0 for empty and for binary content."""
    n = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return (n if binary is None else F.when(binary, 0).otherwise(n)).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def is_binary(content: Column) -> Column:
    return F.position(F.lit(bytearray(b"\x00")), content) > 0


def decode(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1, which never fails."""
    utf8 = F.decode(content, "UTF-8")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def digest(text: Column, chars: int = 64) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, chars)


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def strip_config(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "^CONFIG_", "")


def last_field(uid: Column) -> Column:
    return F.element_at(F.split(uid, "\\|"), -1)


def folded(c: Column) -> Column:
    """Case folded inside the JVM, for keys: full upper case, then lower (``ß`` and ``SS`` meet in ``ss``, both small sigmas in one)."""
    return F.translate(F.lower(F.upper(c)), "ς", "σ")


def casefold(c: Column) -> Column:
    """Unicode case folding (``ß`` becomes ``ss``); for ASCII identifiers ``lower`` is the same and faster."""

    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.casefold(), na_action="ignore")

    return fold(c)


def ascii_json(c: Column) -> Column:
    """JSON of a struct or map with non-ASCII characters escaped, as the exported files have it."""

    @F.pandas_udf(T.StringType())
    def escape(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(ch if ord(ch) < 128 else "".join(f"\\u{u:04x}" for u in _units(ch)) for ch in x), na_action="ignore")

    return escape(F.to_json(c))


def _units(ch: str) -> list[int]:
    raw = ch.encode("utf-16-be", "surrogatepass")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


def utc_stamp(c: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if c is None else c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
