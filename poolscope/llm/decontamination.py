"""Benchmark decontamination with spaced-seed hashes.

Texts are lower-cased, ASCII punctuation becomes blanks, and words are compared. Each
of the fixed ``MASKS`` looks at some of the words at consecutive positions and
ignores the others, so a hash still matches when ignored words were replaced. The
first five hit any six words of which at most one differs; the others hit the
arrangements in which every six words have two that differ. Together they hit every
stretch of ``SHORTEST`` words or more of which at most a quarter differ, so for the
default ``SHARE`` and ``LEAST`` no overlap is missed (smaller shares can be). Every
position of every document is hashed under every mask and joined with the
benchmark's hashes. Each diagonal with a hit (document position minus item position)
is then compared word by word, and its longest stretch with at least ``SHARE`` equal
words counts: a document is contaminated by an item when that stretch has ``LEAST``
words, or the whole item where it is shorter.

The benchmark is worked off in blocks of ``BLOCK_WORDS`` words at most (one longer
item is a block of its own), each sent to all tasks; the documents are mapped once
per block and never shuffled. So memory is bounded whatever the benchmark's size,
and a passage shared by any number of documents costs only its own verification.

Defined results: null or empty text: never contaminated. Items with fewer words
than ``SHORTEST`` are too short to tell from chance and match nothing. Null
ids of documents: reported with a null id. Repeated benchmark rows count once,
repeated documents each. Empty tables: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.tables import join_by_size, stored
from poolscope.llm.words import byte_texts, mix, word_hashes

MASKS = (
    "11111", "111101", "111011", "110111", "101111",
    "11001111", "11010111", "11011011", "11100111", "11101011", "11110011",
)
SHORTEST = 8
SHARE = 0.75
LEAST = 12
BLOCK_WORDS = 1_000_000
TABLE_BITS = 22
GROUP_WORDS = 1 << 15

_PLAIN = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def plain_words(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").decode().lower().encode().translate(_PLAIN).split())


def mask_hashes(words: np.ndarray, masks: tuple[str, ...]) -> Iterator[np.ndarray]:
    """For each mask its hash at every position where it fits; words are hashes already."""
    terms: dict[int, np.ndarray] = {}
    for number, mask in enumerate(masks):
        n = len(words) - len(mask) + 1
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        total = np.full(n, _FACTORS[number], np.uint64)
        for at, looked in enumerate(mask):
            if looked == "1":
                if at not in terms:
                    terms[at] = words * _FACTORS[at]
                total += terms[at][at : at + n]
        yield total


class Items:
    """A block of the benchmark: word hashes of its items and their mask hashes."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [plain_words(text) for _, text in items]
        self.masks = masks
        found = [
            (hashes, t) for t, words in enumerate(self.words) if len(words) >= SHORTEST for hashes in mask_hashes(words, masks)
        ]
        hashes = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
        item = np.repeat([t for _, t in found], [len(h) for h, _ in found]).astype(np.int64)
        place = np.concatenate([np.arange(len(h)) for h, _ in found] or [np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.shift = np.uint64(64 - TABLE_BITS)
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def diagonals(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, text position minus item position) of every hit, each once.

        ``words`` are those of several texts on end, ``starts`` where each begins. A hit over
        the seam of two texts is only a diagonal to be compared.
        """
        text, item, shift = [], [], []
        for hashes in mask_hashes(words, self.masks):
            at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
            lo = np.searchsorted(self.hashes, hashes[at], "left")
            times = np.searchsorted(self.hashes, hashes[at], "right") - lo
            at, lo, times = (x[times > 0] for x in (at, lo, times))
            if not len(at):
                continue
            spot = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            owner = np.searchsorted(starts, at, "right") - 1
            text.append(np.repeat(owner, times))
            item.append(self.item[spot])
            shift.append(np.repeat(at - starts[owner], times) - self.place[spot])
        if not text:
            return (np.zeros(0, np.int64),) * 3
        text, item, shift = map(np.concatenate, (text, item, shift))
        order = np.lexsort((shift, item, text))
        text, item, shift = text[order], item[order], shift[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
        return text[new], item[new], shift[new]


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """[start, stop) of the longest stretch with at least that share of equal words.

    A stretch qualifies when the running sum of (equal - share) does not fall over it;
    for each end the earliest start is found in the running minima.
    """
    sums = np.concatenate(([0.0], np.cumsum(equal - share)))
    least = np.minimum.accumulate(sums)
    start = len(least) - np.searchsorted(least[::-1], sums + 1e-9, "right")
    length = np.arange(len(sums)) - start
    stop = int(length.argmax())
    return int(start[stop]), stop


def overlaps(texts: list[np.ndarray], items: Items, share: float, least: int) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words of the longest stretch, equal words in it, its start), by text and item."""
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, t, shift in zip(*(x.tolist() for x in items.diagonals(np.concatenate(texts), starts)), strict=True):
        words, item = texts[d], items.words[t]
        lo, hi = max(0, shift), min(len(words), shift + len(item))
        asked = min(least, len(item))
        if hi - lo < asked:
            continue
        equal = words[lo:hi] == item[lo - shift : hi - shift]
        if np.count_nonzero(equal) < share * asked - 1e-9:
            continue
        start, stop = longest_stretch(equal, share)
        if stop - start >= asked:
            row = (stop - start, int(equal[start:stop].sum()), lo + start)
            best[d, t] = max(best.get((d, t), row), row, key=lambda r: (r[0], r[1], -r[2]))
    return [(*k, *row) for k, row in sorted(best.items())]


def text_groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Words of texts in order, about ``GROUP_WORDS`` at a time, with the place of the first text."""
    held, size = [], 0
    for at, text in enumerate(texts):
        held.append(plain_words(text))
        size += len(held[-1])
        if size >= GROUP_WORDS or at + 1 == len(texts):
            yield at + 1 - len(held), held
            held, size = [], 0


def item_blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in order of id, cut into blocks; one block is held at a time."""
    rows = benchmark.filter("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    held, size = [], 0
    for row in rows.toLocalIterator():
        text = row.text.encode()
        n = len(text.split())
        if held and size + n > words:
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += n
    if held:
        yield held


KIND = "doc_id long, item_id long, n_words long, n_equal long, at long"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, share: float = SHARE,
    least: int = LEAST, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal, at): each document with each item found in it.

    The longest stretch starts at word ``at`` of the document's plain words.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")

    def found_in(block) -> DataFrame:
        def run(batches):
            items = block.value
            for batch in batches:
                docs = batch.column(0).to_pylist()
                for first, texts in text_groups(byte_texts(batch.column(1))):
                    out = [(docs[first + d], items.ids[t], *row) for d, t, *row in overlaps(texts, items, share, least)]
                    columns = list(zip(*out, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_words", "n_equal", "at"]
                    )

        return docs.mapInArrow(run, KIND)

    parts = [
        found_in(spark.sparkContext.broadcast(Items(block, masks))) for block in item_blocks(benchmark, block_words)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], KIND)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any item of the benchmark, with the columns of ``docs``.

    Texts are judged, by a 64-bit hash, not ids: rows without an id go when their text is
    contaminated, and of rows that share an id only those do whose text is.
    """
    key = "decontamination_text_hash"
    hashed = F.xxhash64("text")
    bad = contaminated(docs.select(hashed.alias("doc_id"), "text"), benchmark, **options)
    bad = stored(bad.select(F.col("doc_id").alias(key)).distinct(), "decontamination-bad")
    return join_by_size(docs.withColumn(key, hashed), bad, key, "left_anti").drop(key)
