"""Small text helpers whose Spark built-ins behave differently from what we need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_or_null(col: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` that gives null instead of '' without a match."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def pad_right(col: Column, width: int) -> Column:
    """Pad with spaces to ``width``; longer text is kept whole."""
    return F.concat(col, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(col))))


def pad_left(col: Column, width: int | Column) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(col))), col)


def json_object(*fields: Column) -> Column:
    """JSON text with the fields in the given order and nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def encode_tab_text(col: Column) -> Column:
    """Backslash escapes for a tab-separated file; null becomes ``\\N``."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return F.coalesce(out, F.lit("\\N"))


def encode_tab_bytes(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("\\x"), F.lower(F.hex(col))), F.lit("\\N"))


def decode_tab_text(col: Column) -> Column:
    """Inverse of ``encode_tab_text``."""

    def unescape(piece: Column) -> Column:
        for mark, raw in (("\\r", "\r"), ("\\n", "\n"), ("\\t", "\t")):
            piece = F.replace(piece, F.lit(mark), F.lit(raw))
        return piece

    # Doubled backslashes are cut out first, so no escape is read across them.
    pieces = F.split(col, r"\\\\", -1)
    plain = F.array_join(F.transform(pieces, unescape), "\\")
    return F.when(col == "\\N", F.lit(None).cast("string")).otherwise(plain)


def decode_tab_bytes(col: Column) -> Column:
    return F.when(col == "\\N", F.lit(None).cast("binary")).otherwise(
        F.unhex(col.substr(F.lit(3), F.length(col)))
    )
