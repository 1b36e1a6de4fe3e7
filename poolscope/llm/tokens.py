"""Token ids in a bit-packed binary file format.

Format: a folder of Parquet files written by Spark, so a lost task leaves nothing
behind. A row is one block of whole documents in ascending order of id: ``shard``
(ascending ranges of ids), ``block`` and ``first`` (ids of the shard before it),
``least`` and ``most`` (smallest and largest doc_id), ``doc_ids`` and ``offsets``
(documents and where their ids start in the block, with the end as last offset),
``bits``, and ``payload``: the ids of the block in ``bits`` bits each, the least that
hold the vocabulary, id ``i`` at bit ``i * bits`` of little-endian 64-bit words.
Blocks close at ``BLOCK`` ids. A document is found by its block's id range, which
Parquet's statistics prune, and unpacked from its bit offset alone.

Texts are encoded where they are read; their ids, not the texts, are dealt by ranges of
doc_id, whose bounds come from the ids alone, and sorted inside a range. ``by_word=True``
encodes each word once and remembers it. That is right only for tokenizers that drop white space, never
join across it, lower-case A-Z and U+00C0 to U+00DE, cut words of ``LETTERS`` nowhere and cut between an
ASCII letter or digit and ASCII punctuation, as ``TOKENIZER`` does; others need the default, which encodes whole texts.

Defined results: null text: only the end id. Null doc_ids come first; rows of one id, and those
without one, are in order of their token ids' bytes. Repeated rows: one entry each. Empty
table: no rows. A text that alone exceeds ``BLOCK`` is a block of its own. Other columns are
ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from itertools import compress, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolscope.llm.tables import fresh_path
from poolscope.llm.words import byte_texts

TOKENIZER = "word_bpe_49k.json"
VOCABULARY = 49_408
END = 1
BLOCK = 1 << 16
REMEMBERED = 800_000
REMEMBERED_BYTES = 32 << 20
TOGETHER = 1000
PIECE_BYTES = 1 << 20
PUNCTUATION = string.punctuation.encode()
#: Words of one script in composed form, which normalizing only lower-cases: a-z and the letters U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

FORMAT = (
    "shard int, block int, first long, least long, most long, doc_ids array<long>,"
    " offsets array<long>, bits int, payload binary"
)


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; 64 ids fill ``bits`` words, so columns of 64 are shifted at once."""
    groups = -(-len(ids) // 64)
    rows = np.zeros((groups, 64), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    size = -(-len(ids) * bits // 8)
    return out.astype("<u8").tobytes()[:size]


def unpacked(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a block, reading only the groups of 64 that hold them."""
    low, high = start // 64, -(-stop // 64)
    raw = payload[low * 8 * bits : high * 8 * bits]
    words = np.frombuffer(raw.ljust((high - low) * 8 * bits, b"\0"), "<u8").reshape(high - low, bits)
    out = np.empty((high - low, 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        column = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            column = column | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = column & mask
    return out.ravel()[start - low * 64 : stop - low * 64]


class Encoder:
    """Ids of texts.

    Words not met before are encoded many at a time. Those of Latin letters alone (``LETTERS``) skip
    the tokenizer's normalizer and regular expressions, which leave them whole: its model gets them
    through its byte alphabet, and the model's suffix of a word's last token tells them apart.
    The others are encoded with a special token of the tokenizer between
    them, which it never joins with its neighbours. A word is a core and a tail of
    punctuation; each of these parts has its ids in one growing array.
    """

    _ready: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        added = self.tokenizer.get_added_tokens_decoder()
        plain = [(i, t.content) for i, t in sorted(added.items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.cut = plain[0] if plain else None
        self.marks = {c.encode() for t in added.values() for c in t.content if not c.isalnum()}
        self.plain, self.last = self._plain()
        self._forget()

    def _plain(self):
        """The tokenizer without normalizer and cutting, and which ids end a word; None where its model does not mark them."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None, None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return plain, last

    @classmethod
    def of(cls, path: str, by_word: bool) -> Encoder:
        """One per Python worker, which keeps the words it remembers for later tasks."""
        if (path, by_word) not in cls._ready:
            cls._ready[path, by_word] = cls(path, by_word)
        return cls._ready[path, by_word]

    def _forget(self) -> None:
        # White space at either end of a text is cut off as an empty word, which has no ids.
        self.words: dict[bytes, int] = {b"": 0}
        self.parts: dict[bytes, int] = {b"": 0}
        self.core, self.tail = array("q", [0]), array("q", [0])
        self.first, self.count, self.flat = array("q", [0]), array("q", [0]), array("I")
        self.size = 0

    def _encode(self, texts: list[bytes], tokenizer=None) -> list[np.ndarray]:
        found = (tokenizer or self.tokenizer).encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _learn_parts(self, fresh: list[bytes]) -> None:
        """Encode and remember parts of words."""
        whole = [self.plain is not None and LETTERS(p) is not None for p in fresh]
        letters, fresh = list(compress(fresh, whole)), [p for p, x in zip(fresh, whole, strict=True) if not x]
        alone, rest = (fresh, []) if self.cut is None else self._marked(fresh)
        groups = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        between = self.cut[1].encode() if self.cut else b""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        lines = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for group, found in zip(lines, self._encode([b" ".join(g).decode().lower().encode() for g in lines], self.plain), strict=True):
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(group):
                raise ValueError("the tokenizer's model does not mark the ends of words")
            counts.append(np.diff(ends, prepend=0))
            ids.append(found)
        for group, found in zip(groups, self._encode([between.join(g) for g in groups]), strict=True):
            ends = np.append(np.flatnonzero(found == self.cut[0]), len(found))
            if len(ends) != len(group):
                raise ValueError("the tokenizer does not keep its special token apart")
            counts.append(np.diff(ends, prepend=-1) - 1)
            ids.append(found[found != self.cut[0]])
        for found in self._encode(alone):
            counts.append(np.array([len(found)]))
            ids.append(found)
        counts = np.concatenate(counts)
        self.parts.update(zip([*letters, *rest, *alone], range(len(self.count), len(self.count) + len(counts)), strict=True))
        self.first.extend((len(self.flat) + np.cumsum(counts) - counts).tolist())
        self.count.extend(counts.tolist())
        self.flat.frombytes(np.concatenate(ids).astype(np.uint32).tobytes())

    def _learn(self, words: list[bytes]) -> None:
        """Remember words.

        A word is cut where the tokenizer cuts it for certain, between a letter or
        digit and the ASCII punctuation at its end, and A-Z is lower-cased as it does;
        words with a mark of a special token are left alone.
        """
        marked, plain = self._marked(words)
        bare = [w.rstrip(PUNCTUATION) for w in plain]
        cut = [(b.lower(), w[len(b) :]) if b[-1:].isalnum() else (w, b"") for w, b in zip(plain, bare, strict=True)]
        cores, tails = [*marked, *[c for c, _ in cut]], [*[b""] * len(marked), *[t for _, t in cut]]
        fresh = list(filterfalse(self.parts.__contains__, {*cores, *tails}))
        if fresh:
            self._learn_parts(fresh)
        self.words.update(zip([*marked, *plain], range(len(self.core), len(self.core) + len(cores)), strict=True))
        self.core.extend(map(self.parts.__getitem__, cores))
        self.tail.extend(map(self.parts.__getitem__, tails))
        self.size += sum(map(len, words))

    def _marked(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Words that hold a mark of a special token, and the others."""
        whole = b" ".join(words)
        if not any(m in whole for m in self.marks):
            return [], words
        hold = [any(m in w for m in self.marks) for w in words]
        return list(compress(words, hold)), list(compress(words, [not h for h in hold]))

    def together(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's begin, with the end."""
        if not self.by_word:
            ids = self._encode([t or b"" for t in texts])
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, ids)])
        column = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(column)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        # Looked up one by one: a difference with the keys would go through all that is remembered.
        known = list(map(self.words.get, words))
        fresh = [w for w, i in zip(words, known, strict=True) if i is None]
        if len(self.words) + len(fresh) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self._forget()
            known, fresh = [None if w else 0 for w in words], list(filter(None, words))
        self._learn(fresh)
        new = map(self.words.__getitem__, fresh)
        known = [next(new) if i is None else i for i in known]
        at = np.array(known, np.int64)[coded.indices.to_numpy()]
        parts = np.column_stack([np.frombuffer(x, np.int64)[at] for x in (self.core, self.tail)]).ravel()
        counts = np.frombuffer(self.count, np.int64)[parts]
        ends = np.concatenate([[0], np.cumsum(counts)])
        spots = np.repeat(np.frombuffer(self.first, np.int64)[parts] - ends[:-1], counts) + np.arange(ends[-1])
        ids = np.frombuffer(self.flat, np.uint32)[spots] if len(spots) else np.zeros(0, np.uint32)
        return ids, ends[2 * split.offsets.to_numpy()]

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, ends = self.together(texts)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def encoded(docs: DataFrame, tokenizer: str, vocabulary: int, end: int, by_word: bool, bounds: list[int]) -> DataFrame:
    """(shard, doc_id, ids): the ids of each document, its end included, in 1, 2 or 4 bytes each."""
    kind = width_type(vocabulary, end)
    limits = np.array(bounds, np.int64)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(tokenizer, by_word)
        for batch in batches:
            step = max(1, PIECE_BYTES * batch.num_rows // (batch.column(1).get_total_buffer_size() + 1))
            for low in range(0, batch.num_rows, step):
                piece = batch.slice(low, step)
                ids, ends = encoder.together(byte_texts(piece.column(1)))
                closed = np.insert(ids, ends[1:], end).astype(kind)
                offsets = (ends + np.arange(len(ends))) * kind.itemsize
                payload = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), piece.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(closed)]
                )
                known = piece.column(0).is_null().to_numpy(zero_copy_only=False)
                shard = np.where(known, 0, np.searchsorted(limits, piece.column(0).fill_null(0).to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), piece.column(0), payload.cast(pa.binary())], ["shard", "doc_id", "ids"]
                )

    columns = docs.select(F.col("doc_id").cast("long"), "text")
    return columns.mapInArrow(run, "shard int, doc_id long, ids binary")


def width_type(vocabulary: int, end: int) -> np.dtype:
    """The least unsigned little-endian type that holds every id."""
    return next(np.dtype(t) for t in ("<u1", "<u2", "<u4") if max(vocabulary - 1, end) <= np.iinfo(t).max)


def write_tokens(
    docs: DataFrame, target: str, tokenizer: str, vocabulary: int, end: int = END, block: int = BLOCK,
    by_word: bool = False,
) -> None:
    """Write the texts' ids, each document closed by ``end``, to the folder ``target``."""
    bits, kind = width_of(max(vocabulary, end + 1)), width_type(vocabulary, end)
    names = [f.split(" ")[-2].strip() for f in FORMAT.split(",")]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.int32(), pa.binary())

    def run(batches):
        number, before, size = 0, 0, 0
        docs_held: list[int | None] = []
        ids_held: list[bytes] = []

        def close():
            ends = np.cumsum([0] + [len(b) // kind.itemsize for b in ids_held])
            named = [d for d in docs_held if d is not None]
            row = (
                [shard], [number], [before], [min(named, default=None)], [max(named, default=None)],
                [docs_held], [ends.tolist()], [bits], [packed(np.frombuffer(b"".join(ids_held), kind), bits)],
            )
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for shard, doc, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                n = len(ids) // kind.itemsize
                if docs_held and size + n > block:
                    yield close()
                    number, before, docs_held, ids_held, size = number + 1, before + size, [], [], 0
                docs_held.append(doc)
                ids_held.append(ids)
                size += n
        if docs_held:
            yield close()

    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / shards for i in range(1, shards)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first().b if shares else []
    dealt = encoded(docs, tokenizer, vocabulary, end, by_word, bounds or []).repartitionById(shards, "shard")
    in_order = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    in_order.mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(target)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def written_digests(docs: DataFrame) -> DataFrame:
    """Write the token file of ``TOKENIZER`` to the shared folder and read ``digests`` back from it."""
    target = fresh_path(docs.sparkSession, "token-file")
    write_tokens(docs, target, tokenizer_path(), VOCABULARY, by_word=True)
    return digests(read_tokens(docs.sparkSession, target))


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """The blocks of a written folder with ``start``, the ids of all blocks before."""
    blocks = spark.read.schema(FORMAT).parquet(target)
    sizes = blocks.select("shard", F.element_at("offsets", -1).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("shard").alias("_s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return (
        blocks.join(bases, F.col("shard") == F.col("_s"))
        .withColumn("start", F.col("base") + F.col("first")).drop("_s", "base")
    )


def documents_of(blocks: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the blocks' documents, or of the ``wanted`` few.

    Only blocks whose id range holds a wanted id are read, and only its bits unpacked.
    """
    if wanted is not None:
        ranges = [(F.col("least") <= i) & (F.col("most") >= i) for i in wanted]
        hit = F.lit(False)
        for r in ranges:
            hit = hit | r
        blocks = blocks.filter(hit)

    def run(batches):
        chosen = None if wanted is None else set(wanted)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("start", "bits", "payload", "doc_ids", "offsets")]
            for start, bits, payload, docs, offsets in zip(*columns, strict=True):
                rows = [i for i, d in enumerate(docs) if chosen is None or d in chosen]
                ids = [unpacked(payload, bits, offsets[i], offsets[i + 1]) for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[i] for i in rows], pa.int64()),
                     pa.array([start + offsets[i] for i in rows], pa.int64()),
                     pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    kept = blocks.select("start", "bits", "payload", "doc_ids", "offsets")
    return kept.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the packed ids."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("start", "bits", "payload", "doc_ids", "offsets")]
            for start, bits, payload, docs, offsets in zip(*columns, strict=True):
                raw = memoryview(unpacked(payload, bits, 0, offsets[-1]).astype("<u4").tobytes())
                ends = [4 * o for o in offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([start + o for o in offsets[:-1]], pa.int64()),
                     pa.array([b - a for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64()),
                     pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    kept = blocks.select("start", "bits", "payload", "doc_ids", "offsets")
    return kept.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
