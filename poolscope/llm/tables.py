"""Shared steps: stored tables, size-checked joins on ids, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.plans.storage import fresh_path, stored

__all__ = ["components", "fresh_path", "held_out", "join_by_size", "stored"]

#: Bytes of a table that may be broadcast, at ``row_bytes`` a row and 8 an element of its array.
BROADCAST_BYTES = 32 << 20


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``, is ``part``; null ids: false."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part
    return F.coalesce(rest, F.lit(False))


def join_by_size(
    big: DataFrame, small: DataFrame, key: str, how: str, array: str | None = None, most: int | None = None,
    row_bytes: int = 32,
) -> DataFrame:
    """Join a stored table on ``key``, shipping it only when it takes less than ``most`` bytes.

    Its rows, and the elements of its one ``array`` column if it has any, are counted
    first. Larger tables are joined by shuffling both sides.
    """
    elements = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    size = small.agg((row_bytes * F.count("*") + 8 * elements).alias("bytes")).first().bytes
    return big.join(F.broadcast(small) if size <= (BROADCAST_BYTES if most is None else most) else small, key, how)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node with an edge to another; ``edges`` has long columns a, b.

    Contraction: each node hooks to its neighbour of least hash where that is
    less than its own, hooked nodes are renamed, and edges inside a group go. A
    round is three aggregations or joins on the edges that are left, which shrink
    geometrically; each is a written table, so a lost executor costs one round.
    """
    rank = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = stored(both.filter("a <> b").distinct(), f"{label}-edges")
    names = None
    while not live.isEmpty():
        hook = stored(
            live.groupBy("a").agg(F.min(rank).alias("least"), F.first(own).alias("own"))
            .select("a", F.when(F.col("least") < F.col("own"), F.col("least.v")).otherwise(F.col("a")).alias("to")),
            f"{label}-hooks",
        )
        if names is None:
            names = hook.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = hook.select(F.col("a").alias("root"), "to")
            names = stored(
                names.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")),
                f"{label}-names",
            )
        left = hook.select("a", F.col("to").alias("_a"))
        right = hook.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        live = stored(
            live.join(left, "a").join(right, "b").filter("_a <> _b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(),
            f"{label}-edges",
        )
    if names is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
