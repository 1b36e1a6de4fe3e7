"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Sources in code-point order, null last, weigh 1, 2, 3, repeating. Their targets
share all words by weight; no target exceeds ``MOST`` times its source, and what
that leaves is shared again by weight. Blocks of ``BLOCK`` words go to sources by
highest quotients ``target / (2 s + 1)``, and a source's blocks go to its shards in
the same way, so quotas are integers at both levels.

A shard takes whole passes over its words while its quota covers them; the rest is
one run of consecutive blocks, starting at a seeded block of the shard's documents
in seeded order. A document's share is thus found by one running sum inside its
shard and no row is made per block or word. Shards are cut by hash of the id;
there are more of them the larger the source, so a hot source is spread out.

A source gets within a block of its target, and a document between 0 and ``MOST``
times its words. The choice depends on ids, sizes and the seed only.

Defined results: null text: no words, nothing taken. Null source: its own source,
ordered last. Null ids: one document each, alike in order. Repeated rows are
documents of their own; which of two identical rows comes first does not show.
A source without words has target 0. Empty table: empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.llm.tables import stored
from poolscope.llm.words import WORD

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 8
SHARD_WORDS = 1 << 16
SHARDS = 4096
SEED = 17


def _upto(window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size counts the words of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row per source.

    Sources are filled up to ``most`` times their size in the order of that bound per
    weight; the first whose bound exceeds the level left for all others ends this, and
    the others share what remains by weight. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("bound", (most * F.col("source_size")).cast("double"))
    filled = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    capped = F.col("bound") <= F.col("level") * F.col("weight")
    return (
        rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("rest", F.min(F.when(~capped, F.struct(F.col("bound") / F.col("weight"), "level"))).over(everything))
        .select("source", "source_size", F.when(capped, F.col("bound")).otherwise(F.col("rest.level") * F.col("weight")).alias("target"))
    )


def apportioned(rows: DataFrame, group: list[str], key: list[Column], votes: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the rows' integer shares of the group's ``seats`` by Sainte-Lague.

    Seats go to the highest quotients ``votes / (2 s + 1)``. At the divisor
    ``sum(votes) / seats`` rounding gives nearly all of them; the total is then off by
    at most half the number of rows, so only the next quotients of each row, up to
    its part of that, are ranked to add or take back the difference. Ties by ``key``.
    """
    whole = Window.partitionBy(*group)
    seat_total, votes_total = F.col(seats), F.sum(votes).over(whole)
    start = F.when(votes_total > 0, F.round(F.col(votes) * seat_total / votes_total)).otherwise(0).cast("long")
    share = F.when(votes_total > 0, F.col(votes) / votes_total).otherwise(0.0)
    based = (
        rows.withColumn("_key", F.struct(*key)).withColumn("_start", start)
        .withColumn("_off", seat_total - F.sum("_start").over(whole))
        .withColumn("_more", F.ceil(share * F.abs("_off") + 2))
        .withColumn("_off", F.when(votes_total > 0, F.col("_off")).otherwise(0))
    )
    steps = F.when(F.col("_off") > 0, F.sequence(F.lit(0), (F.col("_more") - 1).cast("int"))).when(
        (F.col("_off") < 0) & (F.col("_start") > 0),
        F.sequence(F.lit(1), F.least(F.col("_more"), F.col("_start")).cast("int")),
    )
    quotients = based.withColumn("_step", F.explode_outer(steps))
    adds = F.col("_off") > 0
    nth = F.when(adds, F.col("_start") + F.col("_step")).otherwise(F.col("_start") - F.col("_step"))
    quotient = F.when(F.col("_step").isNotNull(), F.col(votes) / (2 * nth + 1))
    ranked = Window.partitionBy(*group).orderBy(
        F.when(adds, -F.col("_q")).otherwise(F.col("_q")).asc_nulls_last(), F.col("_key"), F.col("_step")
    )
    hit = F.col("_q").isNotNull() & (F.row_number().over(ranked) <= F.abs("_off"))
    counted = quotients.withColumn("_q", quotient).withColumn("_hit", hit.cast("int"))
    return (
        counted.groupBy(*rows.columns, "_start", "_off").agg(F.sum("_hit").alias("_hits"))
        .withColumn(out, F.col("_start") + F.signum(F.col("_off").cast("double")).cast("long") * F.col("_hits"))
        .drop("_start", "_off", "_hits")
    )


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK,
    shard_words: int = SHARD_WORDS, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first) of every row.

    ``taken`` counts the words the mix takes of the document, repeats included;
    ``first`` says how often it takes the document's first word.
    """
    rows = stored(sized(docs), "mixing-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = stored(
        sources.select("source", "source_size")
        .transform(lambda t: source_targets(t, weights, most))
        .join(sources.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"),
        "mixing-targets",
    )
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    quotas = apportioned(
        sources.withColumn("one", F.lit(1)).withColumn("seats", seats),
        ["one"], [F.col("source").isNull(), F.col("source")], "target", "seats", "blocks",
    ).withColumn(
        "shards", F.least(F.lit(shards), 1 + F.floor((F.col("source_size") + F.col("n")) / shard_words)).cast("int")
    ).select(F.col("source").alias("_s"), "source_size", "target", "blocks", "shards")
    quotas = stored(quotas, "mixing-quotas")

    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = rows.join(quotas, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.col("shards")).cast("int"))
    sums = dealt.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("words"))
    shares = apportioned(sums, ["source", "blocks"], [F.col("shard")], "words", "blocks", "quota")

    words, budget = F.col("words"), F.least(F.col("quota") * block, most * F.col("words"))
    passes = F.when(words > 0, F.floor(budget / words)).otherwise(0).cast("long")
    slots = F.ceil(words / block)
    begin = F.when(words > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), slots) * block).otherwise(0)
    shares = shares.select(
        F.col("source").alias("_s"), F.col("shard").alias("_d"), "words", passes.alias("passes"),
        (budget - passes * words).alias("rest"), begin.cast("long").alias("begin"),
    )
    placed = dealt.join(shares, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_d")))
    stop = F.sum("size").over(_upto(Window.partitionBy("source", "shard").orderBy(order, "doc_id", "size")))
    placed = placed.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("stop"), hi) - F.greatest(F.col("start"), lo))

    # The run of blocks goes on at the shard's beginning when it passes the end.
    end = F.col("begin") + F.col("rest")
    again = F.greatest(F.lit(0), end - F.col("words"))
    part = overlap(F.col("begin"), F.least(end, F.col("words"))) + overlap(F.lit(0), again)
    at = F.col("start")
    starts = ((at >= F.col("begin")) & (at < end)) | (at < again)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + part).cast("long").alias("taken"),
        (F.when(F.col("size") > 0, F.col("passes") + starts.cast("long")).otherwise(0)).alias("first"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    Each is repeated as often as the mix takes its first word, so block runs are
    rounded to whole documents. Rows without an id are one document by text size.
    """
    picks = mixture(docs, **options).filter("first > 0").groupBy("doc_id", "size").agg(
        F.max("first").alias("_times")
    )
    picks = stored(picks.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_times"), "mixing-picks")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return (
        docs.withColumn("_words", size)
        .join(picks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .select(*docs.columns)
    )
