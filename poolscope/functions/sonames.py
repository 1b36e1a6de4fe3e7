"""Shared-library names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soname_name(soname: Column) -> Column:
    """Everything up to the last ``.so``; the whole text when there is none."""
    return F.when(
        F.contains(soname, F.lit(".so")), F.concat(_before_last(soname), F.lit(".so"))
    ).otherwise(soname)


def soname_version(soname: Column) -> Column:
    """What follows the last ``.so``, empty when there is none."""
    return F.when(
        F.contains(soname, F.lit(".so")), F.substring_index(soname, ".so", -1)
    ).otherwise(F.lit(""))


def _before_last(soname: Column) -> Column:
    tail = F.length(F.substring_index(soname, ".so", -1))
    return soname.substr(F.lit(1), F.length(soname) - tail - 3)


def soname_satisfies(have: Column, want: Column) -> Column:
    """``have`` equals ``want`` or extends it by a dotted part."""
    return (have == want) | have.startswith(F.concat(want, F.lit(".")))


def dotted_prefixes(have: Column) -> Column:
    """All ``want`` values that ``have`` satisfies.

    Exploding these turns the prefix test into an equality join key.
    """
    parts = F.split(have, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
    )
