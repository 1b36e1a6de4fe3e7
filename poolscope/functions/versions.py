"""Version ordering as native column expressions (no Python on the executors).

``version_key`` turns a version into text whose byte order is version order, so
sorting, ``max`` and range tests on versions are ordinary string operations.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rank of every non-digit character, lowest first. "|" marks
# the end of a run, so "~" sorts before the end and letters after it.
RANKED = "~|" + ascii_uppercase + ascii_lowercase + "+-."
RANK_CODES = "".join(chr(48 + i) for i in range(len(RANKED)))
PLACEHOLDERS = "".join(chr(0xA1 + i) for i in range(len(RANKED)))
END = PLACEHOLDERS[RANKED.index("|")]
SHORT, MEDIUM = 3, 9
LENGTH_MARKS = "".join(chr(0x100 + n) for n in range(MEDIUM))
LENGTH_CODES = "".join(chr(48 + n) for n in range(MEDIUM))
NO_EPOCH = "00"
# Lengths up to this have one character, below the placeholders; longer ones follow a
# mark above those characters and outside the placeholders.
LONGEST_MARK = 100
LONGER = 255
WELL_FORMED = "^([0-9]+:)?[A-Za-z0-9.+~-]+$"


def _number(digits: Column) -> Column:
    """Digits without leading zeros behind a mark of their length."""
    bare = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    return F.concat(_length_mark(F.length(bare)), bare)


def _length_mark(length: Column) -> Column:
    """Text that sorts by length; no number of digits is too long."""
    return F.when(length <= LONGEST_MARK, F.char(length + 47)).otherwise(
        F.concat(F.char(F.lit(LONGER)), F.lpad(length.cast("string"), 10, "0"))
    )


def _body_key(body: Column) -> Column:
    """Key of upstream version and revision, the revision starting at the last "-".

    Both go through one pass: a missing revision reads like an empty one. The
    characters are ranked with placeholders first, because the final codes may
    look like digits.
    """
    tail = F.substring_index(body, "-", -1)
    marked = F.when(
        F.contains(body, F.lit("-")),
        F.concat(
            body.substr(F.lit(1), F.length(body) - F.length(tail) - 1), F.lit("|!"), tail
        ),
    ).otherwise(F.concat(body, F.lit("|!")))
    held = F.regexp_replace(
        F.translate(marked, RANKED, PLACEHOLDERS), "(?<![0-9])0+(?=[0-9])", ""
    )
    coded = (
        F.when(~held.rlike("[0-9]{%d}" % (SHORT + 1)), _marked_lengths(held, SHORT))
        .when(~held.rlike("[0-9]{%d}" % (MEDIUM + 1)), _marked_lengths(held, MEDIUM))
        .otherwise(_zipped_lengths(held))
    )
    return F.translate(
        F.concat(coded, F.lit(END)), PLACEHOLDERS + LENGTH_MARKS, RANK_CODES + LENGTH_CODES
    )


def _marked_lengths(held: Column, longest: int) -> Column:
    """Mark the word end and the length before every digit run.

    One replacement per length keeps the whole key in generated code.
    """
    for n in range(1, longest + 1):
        held = F.regexp_replace(
            held, "(?<![0-9])([0-9]{%d})(?![0-9])" % n, END + LENGTH_MARKS[n - 1] + "$1"
        )
    return held


def _zipped_lengths(held: Column) -> Column:
    """The same for runs of any length, word by word."""
    runs = F.zip_with(
        F.split(held, "[0-9]+", -1),
        F.regexp_extract_all(held, F.lit("([0-9]+)"), 1),
        lambda word, number: F.concat(
            word,
            F.coalesce(
                F.concat(F.lit(END), _length_mark(F.length(number)), number), F.lit("")
            ),
        ),
    )
    return F.array_join(runs, "")


def version_key(version: Column, strict: bool = False, longest: int | None = None) -> Column:
    """Text key whose byte order is version order; null stays null.

    ``strict`` gives null for malformed versions and ``longest`` for those with a number of
    more digits, so such rows can be set aside; keys themselves know no longest number.
    """
    colon = F.instr(version, ":")
    epoch = F.substring_index(version, ":", 1)
    key = F.concat(
        F.when(colon == 0, F.lit(NO_EPOCH)).otherwise(_number(epoch)),
        F.lit("!"),
        _body_key(version.substr(colon + 1, F.length(version))),
    )
    if strict:
        key = F.when(version.rlike(WELL_FORMED), key)
    if longest is not None:
        key = F.when(~version.rlike("[1-9][0-9]{%d}" % longest), key)
    return key


def version_matches(left: Column, op: Column, right: Column) -> Column:
    """Relation test on keys; no operator is true, an unknown one is null."""
    return (
        F.when(op.isNull(), F.lit(True))
        .when(op == "<<", left < right)
        .when(op == "<=", left <= right)
        .when(op == "=", left == right)
        .when(op == ">=", left >= right)
        .when(op == ">>", left > right)
    )


def compare_keys(left: Column, right: Column) -> Column:
    return F.when(left < right, -1).when(left > right, 1).when(left == right, 0)


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1 by version key."""
    return compare_keys(version_key(left), version_key(right))


def total_order(version: Column, key: Column | None = None) -> Column:
    """Sortable struct: key first, raw text as the tie-break."""
    return F.struct(
        (version_key(version) if key is None else key).alias("vk"), version.alias("raw")
    )


def compare_versions_total(left: Column, right: Column) -> Column:
    """Like ``compare_versions`` but only equal texts compare as 0."""
    by_key = compare_versions(left, right)
    return F.when(by_key != 0, by_key).otherwise(compare_keys(left, right))


def full_version(epoch: Column, version: Column, release: Column) -> Column:
    """``epoch:version-release`` without empty epoch and empty or zero release."""
    none = F.lit("")
    return F.concat(
        F.when(F.coalesce(epoch, none) == "", none).otherwise(F.concat(epoch, F.lit(":"))),
        version,
        F.when(F.coalesce(release, none).isin("", "0"), none).otherwise(
            F.concat(F.lit("-"), release)
        ),
    )
