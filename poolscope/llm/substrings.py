"""Substring dedup: seed with winnowed anchors, extend, keep long repeats.

A window is ``WINDOW`` consecutive words of one document. It repeats when the same
words also start in a document of smaller id; words covered by a repeating window
go. Windows are judged on the input.

Seeds: each window's anchor is its least ``GRAM``-word hash (rightmost on ties), so
equal windows have equal anchors and only about 5 % of the positions are anchors.
Neighbouring windows with one anchor form a span. Seeds met by one document only
are dropped.

Extension works on whole groups, never on pairs. Both ways at once, a span equal
to a span of an earlier document repeats in full; each distinct span is then
represented by its first document. Only representatives whose anchor has several
spans are extended word by word: their windows are hashed and the least document
per window found. Touching repeats are merged into maximal ones when the words are
removed. Hashes are 64 bit.

All groupings are aggregations or joins on a hash, so one passage shared by a third
of the documents is spread by partial aggregation and skewed-join splitting.

Defined results: null or empty text: no words, the hash of the empty string. Null
ids: never removed, never a source. Repeated rows (same id and text): equal results;
an id is taken to name one text. Empty table: empty result. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.tables import join_by_size, stored
from poolscope.llm.words import byte_texts, prefix_hash, signed, stretch_hash, windows, word_hashes

WINDOW = 50
GRAM = 12
ROWS = 100_000


def anchor_spans(prefix: np.ndarray, window: int, gram: int):
    """(anchor hash, first window, last window) of every run of windows with one anchor."""
    grams = windows(prefix, gram)
    reach = window - gram + 1
    if len(grams) < reach:
        none = np.zeros(0, np.int64)
        return grams[:0], none, none
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], reach)
    at = len(grams) - 1 - (np.arange(len(views)) + views.argmin(axis=1))
    at = at[::-1]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ends = np.concatenate((starts[1:], [len(at)])) - 1
    return grams[at[starts]], starts, ends


def spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, span, doc_id, lo, hi): windows lo..hi of the document have this anchor."""
    names = ["anchor", "span", "doc_id", "lo", "hi"]

    def run(batches):
        held, rows = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                prefix = prefix_hash(word_hashes(words))
                anchor, lo, hi = anchor_spans(prefix, window, gram)
                held.append((
                    signed(anchor), signed(stretch_hash(prefix, lo, hi + window)),
                    np.full(len(lo), doc, np.int64), lo.astype(np.int32), hi.astype(np.int32),
                ))
                rows += len(lo)
                if rows >= ROWS:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "anchor long, span long, doc_id long, lo int, hi int")


def window_hashes(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(window, doc_id, start) of the windows that start in the wanted ranges (doc_id, ranges)."""
    names = ["window", "doc_id", "start"]

    def run(batches):
        for batch in batches:
            held, rows = [], 0
            columns = batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist()
            for doc, text, ranges in zip(*columns, strict=True):
                every = windows(prefix_hash(word_hashes((text or b"").split())), window)
                lo, hi = ranges[::2], ranges[1::2]
                starts = np.concatenate([np.arange(a, min(b, len(every))) for a, b in zip(lo, hi, strict=True)])
                held.append((signed(every[starts]), np.full(len(starts), doc, np.int64), starts.astype(np.int32)))
                rows += len(starts)
                if rows >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)

    return join_by_size(docs, wanted, "doc_id", "inner", "ranges").select("doc_id", "text", "ranges").mapInArrow(
        run, "window long, doc_id long, start int"
    )


def as_ranges(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, ranges): the stretches [lo, hi + width) of a document, merged where they touch.

    ``ranges`` holds start, stop, start, stop, ... One document's stretches are
    bounded by its own length.
    """

    def run(batches):
        for batch in batches:
            out = []
            for lo, hi in zip(batch.column(1), batch.column(2), strict=True):
                start = lo.values.to_numpy()
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(hi.values.to_numpy()[order] + width)
                new = np.concatenate(([True], start[1:] > stop[:-1]))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(start)])) - 1
                out.append(np.column_stack((start[first], stop[last])).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ranges"]
            )

    # Both lists come in the order of the rows, so they belong together.
    both = rows.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    return both.select("doc_id", "r.lo", "r.hi").mapInArrow(run, "doc_id long, ranges array<int>")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, ranges): the words of the document covered by windows that repeat an earlier one."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    found = stored(spans(docs, window, gram), "substrings-spans")
    seeds = (
        found.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
        .filter("x <> y").select("anchor")
    )
    seeded = stored(found.join(seeds, "anchor", "left_semi"), "substrings-seeded")
    first = seeded.groupBy("anchor", "span").agg(F.min("doc_id").alias("least"))
    first = stored(first, "substrings-first")
    several = first.groupBy("anchor").count().filter("count > 1").select("anchor")
    placed = seeded.join(first, ["anchor", "span"])
    whole = placed.filter("doc_id > least").select("doc_id", "lo", "hi")
    open_ = (
        placed.filter("doc_id = least").join(several, "anchor", "left_semi").select("doc_id", "lo", "hi")
    )
    wanted = stored(as_ranges(open_, 1), "substrings-open")
    hashed = stored(window_hashes(docs, wanted, window), "substrings-windows")
    least = (
        hashed.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
    )
    single = (
        hashed.join(least, "window").filter("doc_id > least")
        .select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))
    )
    return as_ranges(whole.unionByName(single), window)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept`` is the text that stays."""
    ranges = stored(repeated_ranges(docs, window, gram), "substrings-ranges")
    joined = join_by_size(docs.select("doc_id", "text"), ranges, "doc_id", "left", "ranges")

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                piece = batch.slice(part, 500)
                words, removed, kept = [], [], []
                for text, ranges in zip(byte_texts(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                    own = (text or b"").split()
                    words.append(len(own))
                    if ranges:
                        edges = [0, *ranges, len(own)]
                        own = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in own[a:b]]
                    removed.append(words[-1] - len(own))
                    kept.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string"
    )


def kept_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return without_repeats(docs, window, gram).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
