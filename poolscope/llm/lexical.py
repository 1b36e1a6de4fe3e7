"""Ranked lexical search by a dual-tree search over items and documents.

Terms are maximal runs of characters other than ASCII signs and blanks, A-Z lower-cased. The
score of a document for an item is the sum, over the item's distinct terms, of the
term's weight times the document's value of that term (``value_of``); all in integers,
so results are the same however the work is cut.

The documents are read once per block of items: a task counts the terms of its documents that
some item has, packs them by ``PIECE`` documents and counts how many documents hold each term.
Packed documents and counts are written to the shared folder. When the counts
of all documents are known, the packed documents are searched. A hierarchy over the
items, groups of ``FAN``, holds the union of their terms; one over the documents of a
piece holds the greatest value of each term. A pair of nodes is opened
only if the union's weights with the greatest values reach the weakest k-th score
among the node's items, so a bound that is too low rules out all their items and
documents at once, and none that belongs to the result. The items' weakest k-th
scores rise from piece to piece; a first search over about ``SEEDS`` packed pieces gives values that
every later task starts from. Each task gives at most k documents per item; their best k are the result.

Items are worked off in blocks of about ``BLOCK_BYTES`` of text (a longer item is a block by itself or
with few others), one sent to the tasks at a time, its result written before the next. A document
is in one piece of one task, so neither common terms nor copies gather anywhere.

Defined results: null or empty texts of documents have no terms, count for nothing and
are never found. Items without terms have no rows. Null doc_ids are documents, after all
others among equal scores, and come out as null. Repeated documents each have a rank, repeated items are
searched each. Empty tables: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope.llm.tables import fresh_path, stored
from poolscope.llm.words import byte_texts

TOP = 10
FAN = 8
PIECE = 1024
COUNTED_WORDS = 400_000
CELLS = 1 << 24
PAIRS = 1 << 22
SEEDS = 16
BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 4096
NO_ID = np.iinfo(np.int64).max

PACKED = (
    "kind int, docs array<bigint>, sizes array<bigint>, ends array<bigint>, terms array<int>, times array<bigint>,"
    " n_docs bigint, n_terms bigint"
)
FOUND = "number bigint, item_id bigint, doc_id bigint, score bigint"
KINDS = (pa.int32(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64())
NAMES = [x.split(" ")[-2] for x in PACKED.split(",")]

_SIGNS = bytes(
    i if i > 127 or chr(i).isalnum() and not chr(i).isupper() else i + 32 if chr(i).isalpha() else 32 for i in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SIGNS).split()


def weight_of(n_docs: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def value_of(times: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Values, at most 1,000,000, of terms that occur ``times`` in documents of ``size`` terms."""
    m = 100 - 90 + (90 * size * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0..count-1) for every unit of every count."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Items:
    """A block of items: their distinct terms as numbers of a common vocabulary."""

    def __init__(self, rows: list[tuple[int, int | None, bytes | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.numbers, self.ids, self.terms = [], [], []
        for number, item, text in rows:
            own = {self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms_of(text)}
            if own:
                self.numbers.append(number)
                self.ids.append(item)
                self.terms.append(np.array(sorted(own), np.int64))


def packed(docs: DataFrame, items: Items) -> DataFrame:
    """Rows of kind 0: terms of ``PIECE`` documents at most; of kind 1: a task's counts."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches):
        known = sent.value
        many = len(known)
        holding, n_docs, n_terms = np.zeros(many, np.int64), 0, 0

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, KINDS, strict=True)], NAMES)

        def piece(ids, texts):
            sizes = np.array([len(t) for t in texts], np.int64)
            words = np.concatenate([np.fromiter(map(known.get, t, repeat(-1)), np.int64, len(t)) for t in texts])
            owner = np.repeat(np.arange(len(texts)), sizes)
            key, times = np.unique((owner * many + words)[words >= 0], return_counts=True)
            owner, terms = key // many, key % many
            holding[:] += np.bincount(terms, minlength=many)
            per_doc = np.bincount(owner, minlength=len(texts))
            some = per_doc > 0
            shown = [i for i, s in zip(ids, some.tolist(), strict=True) if s]
            return sizes, row(0, shown, sizes[some], np.cumsum(per_doc[some]), terms.astype(np.int32), times, None, None)

        for batch in batches:
            ids, texts, size = [], [], 0
            rows = zip(batch.column(0).to_pylist(), map(terms_of, byte_texts(batch.column(1))), strict=True)
            for last, (doc, own) in enumerate(rows, 1 - batch.num_rows):
                ids.append(doc)
                texts.append(own)
                size += len(own)
                if last == 0 or len(ids) == PIECE or size > COUNTED_WORDS:
                    sizes, made = piece(ids, texts)
                    n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
                    ids, texts, size = [], [], 0
                    yield made
        seen = np.flatnonzero(holding)
        yield row(1, None, None, None, seen.astype(np.int32), holding[seen], n_docs, n_terms)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)


class Level:
    """Nodes of one height of the item tree: the union of their items' terms."""

    def __init__(self, unions: list[np.ndarray]) -> None:
        self.first = np.concatenate([[0], np.cumsum([len(u) for u in unions])])
        self.terms = np.concatenate(unions)
        self.unions = unions

    def above(self) -> Level:
        groups = range(0, len(self.unions), FAN)
        return Level([np.unique(np.concatenate(self.unions[g : g + FAN])) for g in groups])


class Search:
    """The best ``top`` documents of each item among the pieces shown so far."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int) -> None:
        self.weights, self.n_docs, self.n_terms, self.top, self.floor = weights, n_docs, n_terms, top, floor
        shared = np.bincount(np.concatenate(items.terms), minlength=len(weights)) > 1
        rare = [max(t.tolist(), key=lambda x: (bool(shared[x]), weights[x], x)) for t in items.terms]
        self.order = np.lexsort((np.arange(len(rare)), rare))
        self.levels = [Level([items.terms[i] for i in self.order])]
        while len(self.levels[-1].unions) > FAN:
            self.levels.append(self.levels[-1].above())
        self.item, self.score, self.doc = (np.zeros(0, np.int64),) * 3
        self.opened = 0
        self._raise()

    def _raise(self) -> None:
        """Weakest k-th scores of all nodes."""
        weakest = np.maximum(self.floor[self.order], 1)
        full = np.bincount(self.item, minlength=len(weakest)) == self.top
        last = np.full(len(weakest), NO_ID)
        np.minimum.at(last, self.item, self.score)
        weakest[full] = np.maximum(weakest[full], last[full])
        self.weakest = [weakest]
        for _ in self.levels[1:]:
            below = self.weakest[-1]
            self.weakest.append(np.minimum.reduceat(below, np.arange(0, len(below), FAN)))

    def _bounds(self, level: Level, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        counts = level.first[a + 1] - level.first[a]
        out = np.zeros(len(a), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1
        for part in np.split(np.arange(len(a)), cuts):
            owner, at = spread(counts[part])
            terms = level.terms[level.first[a[part]][owner] + at]
            sums = self.weights[terms] * values[b[part][owner], terms]
            if len(part):
                out[part] = np.add.reduceat(sums, np.cumsum(counts[part]) - counts[part])
        return out

    def show(self, docs: np.ndarray, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        step = max(FAN, min(512, CELLS // len(self.weights)))
        owner = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
        values = value_of(times, sizes[owner], self.n_docs, self.n_terms)
        for low in range(0, len(docs), step):
            here = slice(0 if low == 0 else ends[low - 1], ends[min(low + step, len(docs)) - 1])
            self._part(docs[low : low + step], owner[here] - low, terms[here], values[here])

    def _part(self, docs: np.ndarray, owner: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        # Documents with the same heaviest term go side by side.
        heaviest = np.lexsort((values * self.weights[terms], owner))
        ends = np.flatnonzero(np.diff(owner[heaviest], append=-1))
        order = np.lexsort((docs, terms[heaviest[ends]]))
        place = np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        docs = docs[order]
        rows = np.zeros((-(-len(docs) // FAN) * FAN, len(self.weights)), np.int32)
        rows[place[owner], terms] = values
        tree, counts = [rows], [len(docs)]
        while counts[-1] > FAN:
            above = tree[-1].reshape(-1, FAN, rows.shape[1]).max(1)
            counts.append(len(above))
            tree.append(np.pad(above, ((0, -len(above) % FAN), (0, 0))))
        i, d = len(self.levels) - 1, len(tree) - 1
        a = np.repeat(np.arange(len(self.levels[i].unions)), counts[d])
        b = np.tile(np.arange(counts[d]), len(self.levels[i].unions))
        while True:
            self.opened += len(a)
            bound = self._bounds(self.levels[i], tree[d], a, b)
            keep = bound >= self.weakest[i][a]
            a, b, bound = a[keep], b[keep], bound[keep]
            if i == d == 0:
                break
            if i >= d:
                i -= 1
                owner, child = spread(np.minimum(FAN, len(self.levels[i].unions) - a * FAN))
                a, b = a[owner] * FAN + child, b[owner]
                if i + 1 > d:
                    continue
            d -= 1
            owner, child = spread(np.minimum(FAN, counts[d] - b * FAN))
            a, b = a[owner], b[owner] * FAN + child
        self._keep(a, bound, docs[b])

    def _keep(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begin = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(begin, np.diff(begin, append=len(item)))
        best = rank < self.top
        self.item, self.score, self.doc = item[best], score[best], doc[best]
        self._raise()


def found(pieces: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, floor: np.ndarray, top: int) -> DataFrame:
    """At most ``top`` documents per item from every task that reads packed pieces."""
    sent = pieces.sparkSession.sparkContext.broadcast((items, weights, n_docs, n_terms, floor, top))

    def run(batches):
        search = None
        for batch in batches:
            for i in range(batch.num_rows):
                values = [batch.column(k)[i].values for k in range(5)]
                if len(values[0]) == 0:
                    continue
                search = search or Search(*sent.value)
                search.show(values[0].fill_null(int(NO_ID)).to_numpy(), *[v.to_numpy().astype(np.int64) for v in values[1:]])
        if search:
            at = search.order[search.item]
            block = sent.value[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(block.numbers, np.int64)[at]), pa.array([block.ids[i] for i in at.tolist()], pa.int64()),
                 pa.array(search.doc, mask=search.doc == NO_ID), pa.array(search.score)],
                ["number", "item_id", "doc_id", "score"],
            )

    return pieces.select("docs", "sizes", "ends", "terms", "times").mapInArrow(run, FOUND)


def _best(rows: DataFrame, top: int) -> DataFrame:
    by_score = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)


def _searched(docs: DataFrame, items: Items, top: int) -> DataFrame:
    """The result for one block of items."""
    spark = docs.sparkSession
    path = fresh_path(spark, "lexical-packed")
    packed(docs, items).write.partitionBy("kind").parquet(path)
    everything = spark.read.schema(PACKED).parquet(path)
    counts = everything.filter("kind = 1")
    total = counts.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    held = counts.select(F.explode(F.arrays_zip("terms", "times")).alias("x")).groupBy("x.terms").agg(F.sum("x.times"))
    weights = np.full(len(items.vocabulary), weight_of(n_docs, 0), np.int64)
    for term, holding in held.toLocalIterator():
        weights[term] = weight_of(n_docs, holding)
    pieces = everything.filter("kind = 0")
    floor = np.zeros(len(items.ids), np.int64)
    share = max(1, pieces.count() // SEEDS)
    seeds = pieces.filter(F.pmod(F.xxhash64("docs"), F.lit(share)) == 0)
    first = _best(found(seeds, items, weights, n_docs, n_terms, floor, top), top).filter(F.col("rank") == top)
    place = {n: i for i, n in enumerate(items.numbers)}
    for row in first.select("number", "score").collect():
        floor[place[row.number]] = row.score
    return stored(_best(found(pieces, items, weights, n_docs, n_terms, floor, top), top), "lexical-best")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    numbered = stored(
        items.select(F.monotonically_increasing_id().alias("number"), F.col("item_id").cast("long"), "text"), "lexical-items"
    )
    size = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.bytes // block_bytes), -(-size.n // block_items))
    turn = Window.partitionBy(F.spark_partition_id()).orderBy("number")
    dealt = stored(numbered.select("*", F.pmod(F.row_number().over(turn), F.lit(blocks)).alias("block")), "lexical-blocks")
    results = []
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("number", "item_id", F.col("text").cast("binary")).toLocalIterator()
        own = Items([(r.number, r.item_id, r.text and bytes(r.text)) for r in rows])
        if own.ids:
            results.append(_searched(docs, own, top))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, results).select("item_id", "rank", "doc_id", "score")
