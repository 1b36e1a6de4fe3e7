"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q``
apart are identical), of at least ``max(least, 2 * q)`` words, that no neighbouring
word extends with that period.

Each text gets a grammar of its own by Re-Pair in rounds: pairs of neighbouring symbols
are counted, and where a pair that occurs twice or more is commoner than the pairs it
overlaps, it becomes a nonterminal; rounds go on until no pair repeats. Every word of a run is in
a repeated pair, so only stretches of ``least`` such words or more take part. Each nonterminal is
looked at once: the runs of its expansion that cross the boundary of its two parts. What is left of a
text is joined by a balanced tree, whose boundaries are looked at in the same way. For one
boundary and each period, the word beside the boundary is compared with the word a
period away; where they agree, the equal words on both sides are counted with hashes of
prefixes and bisection. The runs of a nonterminal are then moved to all its positions in
the text, and overlapping intervals of one period are merged; the node that just covers a
run has it whole, other nodes have pieces of it. Steps are numpy operations over
several texts at a time.

Work for a text of n words is in the order of n log n, whatever repeats; memory is bounded by
``CHUNK_WORDS`` or the longest text. Texts never leave their task; nothing is shuffled.

Defined results: null or empty text: no words, no runs, empty collapsed text. Null ids and
repeated rows: one row each. Empty table: empty result. Other columns are ignored. Word identity
is by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.words import WORD, byte_texts, mix, prefix_hash, stretch_hash, word_hashes

LEAST = 12
CHUNK_WORDS = 400_000
CHUNK_PERIODS = 2_000_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

_NONE = np.zeros(0, np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0..count-1) for every unit of every count."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_pairs(symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each neighbouring pair its number and how often it occurs; 0 where that is once or parts meet."""
    key = symbols[:-1] << 32 | symbols[1:]
    key[part[1:] != part[:-1]] = -1
    _, pair, count = np.unique(key, return_inverse=True, return_counts=True)
    times = count[pair]
    times[(times < 2) | (key < 0)] = 0
    return pair, times


def live_stretches(symbols: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words in stretches of repeated pairs, and the number of their stretch."""
    _, times = repeated_pairs(symbols, text)
    live = np.zeros(len(symbols), bool)
    live[:-1] = times > 0
    live[1:] |= times > 0
    at = np.flatnonzero(live)
    if not len(at):
        return _NONE, _NONE
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])
    stretch = np.cumsum(new) - 1
    long = np.bincount(stretch)[stretch] >= least
    return at[long], stretch[long]


class Grammar:
    """Rules of all texts: sizes, one position each, and all positions; and what is left of the texts."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, stretch: np.ndarray) -> None:
        self.left, self.size, self.sample = _NONE, _NONE, _NONE
        rules, places = [], []
        symbol, start, size, part = symbols[at], at, np.ones(len(at), np.int64), stretch
        fresh = int(symbols.max(initial=0)) + 1
        while len(symbol) > 1:
            pair, times = repeated_pairs(symbol, part)
            if not times.any():
                break
            first = np.flatnonzero(self._chosen(pair, times))
            made, sample, rule = np.unique(pair[first], return_index=True, return_inverse=True)
            whole = size[first] + size[first + 1]
            self.left = np.append(self.left, size[first[sample]])
            self.sample = np.append(self.sample, start[first[sample]])
            rules.append(rule + len(self.size))
            places.append(start[first])
            self.size = np.append(self.size, whole[sample])
            symbol, size = symbol.copy(), size.copy()
            symbol[first], size[first] = rule + fresh, whole
            fresh += len(made)
            stay = np.ones(len(symbol), bool)
            stay[first + 1] = False
            symbol, start, size, part = symbol[stay], start[stay], size[stay], part[stay]
        rule = np.concatenate(rules) if rules else _NONE
        order = np.argsort(rule, kind="stable")
        self.places = np.concatenate(places)[order] if places else _NONE
        self.times = np.bincount(rule, minlength=len(self.size))
        self.first_place = np.cumsum(self.times) - self.times
        self.start, self.end, self.part = start, start + size, part

    @staticmethod
    def _chosen(pair: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Pairs commoner than those beside them, every second one where a pair overlaps itself."""
        rank = times << 32 | (pair * 0x9E3779B1 & 0xFFFFFFFF)
        rank[times == 0] = 0
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        of = rank[begin]
        beside = np.concatenate([[0], of, [0]])
        best = (of > 0) & (of > beside[:-2]) & (of > beside[2:])
        return best[group] & ((np.arange(len(rank)) - begin[group]) % 2 == 0)

    def tree(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, boundary, to) of a balanced tree over what is left of each stretch."""
        if not len(self.part):
            return _NONE, _NONE, _NONE
        low = np.flatnonzero(np.diff(self.part, prepend=-1))
        high = np.append(low[1:], len(self.part))
        found = []
        while len(low):
            wide = (high - low > 1) & (self.end[high - 1] - self.start[low] >= least)
            low, high = low[wide], high[wide]
            middle = (low + high) // 2
            found.append((self.start[low], self.start[middle], self.end[high - 1]))
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def equal_ahead(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Equal words from ``a`` and ``b`` on (or before them, when ``back``), at most ``most``."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        n = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        if back:
            x, y = x - n, y - n
        same = stretch_hash(prefix, x, x + n) == stretch_hash(prefix, y, y + n)
        low[open_[same]] = n[same]
        high[open_[~same]] = n[~same] - 1


def crossing(
    words: np.ndarray, prefix: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs inside low..high that hold both words at the boundary."""
    half = (high - low) // 2
    found = []
    for right in (True, False):
        periods = np.minimum(half, high - middle if right else middle - low)
        group = np.cumsum(periods) // CHUNK_PERIODS
        for nodes in np.split(np.arange(len(low)), np.flatnonzero(np.diff(group)) + 1):
            owner, q = spread(periods[nodes])
            node, q = nodes[owner], q + 1
            at = middle[node] - (1 if right else q)
            hit = words[at] == words[at + q]
            node, q, at = node[hit], q[hit], at[hit]
            lo, hi = low[node], high[node]
            before, after = np.maximum(at - 1, lo), np.minimum(at + 1, hi - 1 - q)
            hit = (at > lo) & (words[before] == words[before + q]) | (at + 1 + q < hi) & (words[after] == words[after + q])
            node, q, at, lo, hi = node[hit], q[hit], at[hit], lo[hit], hi[hit]
            start = at - equal_ahead(prefix, at, at + q, at - lo, True)
            end = at + q + equal_ahead(prefix, at, at + q, hi - at - q, False)
            long = end - start >= np.maximum(least, 2 * q)
            found.append((node[long], start[long], end[long], q[long]))
    node, start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], q[new]


def merged(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of each period, and of equal intervals the least period, in order of start and period."""
    if not len(start):
        return _NONE, _NONE, _NONE
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    lift = np.unique(q, return_inverse=True)[1] * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + lift)
    new = np.ones(len(start), bool)
    new[1:] = (start + q + lift)[1:] > upto[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    start, end, q = start[begin], (upto - lift)[last], q[begin]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new[: len(start)] = True
    new[1 : len(start)] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep = new[: len(start)]
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def runs(hashes: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run in texts on end; ``text`` numbers each word's text."""
    if len(hashes) < least:
        return _NONE, _NONE, _NONE
    own = mix(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    words = np.unique(own, return_inverse=True)[1].astype(np.int64)
    at, stretch = live_stretches(words, text, least)
    if not len(at):
        return _NONE, _NONE, _NONE
    grammar = Grammar(words, at, stretch)
    prefix = prefix_hash(hashes)
    node, start, end, q = crossing(
        words, prefix, grammar.sample, grammar.sample + grammar.left, grammar.sample + grammar.size, least
    )
    owner, copy = spread(grammar.times[node])
    moved = grammar.places[grammar.first_place[node[owner]] + copy] - grammar.sample[node[owner]]
    _, start_left, end_left, q_left = crossing(words, prefix, *grammar.tree(least), least)
    return merged(
        np.concatenate([start[owner] + moved, start_left]), np.concatenate([end[owner] + moved, end_left]),
        np.concatenate([q[owner], q_left]),
    )


def chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of consecutive texts, about ``CHUNK_WORDS`` together."""
    held, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if held and size + len(words) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def of_chunk(texts: list[list[bytes]], least: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each text."""
    sizes = np.array([len(w) for w in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = [w for text in texts for w in text]
    start, end, q = runs(word_hashes(words), np.repeat(np.arange(len(texts)), sizes), least)
    text = np.searchsorted(first, start, "right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + q, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    collapsed = []
    touched = set(text.tolist())
    for i, own in enumerate(texts):
        stay = compress(own, kept[first[i] : first[i + 1]].tolist()) if i in touched else own
        collapsed.append(b" ".join(stay))
    fields = [pa.array(x, pa.int64()) for x in (start - first[text], end - start, q)]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
    listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return listed, pa.array(collapsed, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    ``runs`` is in order of start and period. ``collapsed`` has the words that are in no
    run after that run's first period, with one space between.
    """

    def run(batches):
        for batch in batches:
            done = 0
            for texts in chunks(byte_texts(batch.column(1))):
                listed, collapsed = of_chunk(texts, least)
                n = pa.array([len(t) for t in texts], pa.int64())
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([ids, n, listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """(doc_id, text) with a repeated ending in one of ``one_in`` documents, chosen by crc32 of the id.

    From word ``a = g % n`` on, the words go round with period ``1 + (n - a) div (3 + g % 8)``,
    where ``g`` is the crc32 divided by ten. Null ids are not chosen.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select(
        "doc_id", "text", F.floor(crc / 10).alias("g"),
        F.when(crc % one_in == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"),
    )
    at = (
        cut.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    )
    round_ = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.expr("cast((n - a + p - 1) div p as int)")))
    ending = F.slice(round_, F.lit(1), F.expr("n - a"))
    changed = F.array_join(F.concat(F.expr("slice(words, 1, a)"), ending), " ")
    return at.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run and SHA-256 digests of ``periodic_runs``."""
    by_length = F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p")))
    best = found.withColumn("best", F.array_max(by_length))
    line: Column = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n"
    )
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(F.lit(""))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
