"""Toxicity by multiple-instance learning over sentences.

A document is toxic when one of its sentences is. A sentence's probability is a
logistic function of its words and of their first ``STEMS`` bytes, hashed to
``2**BITS`` weights; the document's is the noisy-or of its sentences,
``1 - prod(1 - p)``. Weights are trained from document labels alone by gradient
descent on the document's log likelihood, on at most ``SAMPLE`` labelled rows.
Only words and stems in at least ``LEAST`` of those documents that are toxic more
often than chance allows (``SURE`` standard errors) get a weight, so chance words
of a document are not learnt. The same sentence scores then locate the offending
sentences.

Sentences end at . ! ? ; and line ends; other ASCII punctuation separates words;
A-Z is lower-cased.

Defined results: null or empty text: no sentence, score 0. Null ids are scored and
never learnt from. Repeated rows score alike. No usable labels, or only one kind: the
weights stay 0 and documents score by the share of toxic labels per sentence. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.labelled import FOLDS, SAMPLE, labelled_sample
from poolscope.llm.tables import held_out, stored
from poolscope.llm.words import byte_texts, word_hashes

BITS = 18
LEAST = 5
STEMS = (6, 7)
SURE = 5.0
STEPS = 100
RATE = 0.5

_ENDS = b".!?;\n\r"
_TABLE = bytes(
    46 if i in _ENDS else 32 if chr(i) in "\"#$%&()*+,-/:<=>@[\\]^_`{|}~'" else i for i in range(256)
)
_STOP = word_hashes([b"."])[0]
_SENTENCE = re.compile(rb"[^.!?;\n\r]+")


def sentence_words(text: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sentence number, hashed word or stem) of the words of each non-empty sentence, in order."""
    words = (text or b"").lower().translate(_TABLE).replace(b".", b" . ").split()
    hashes = word_hashes(words)
    inside = hashes != _STOP
    sentence = np.cumsum(~inside)[inside]
    if not len(sentence):
        return sentence.astype(np.int64), sentence.astype(np.int64)
    sentence = np.cumsum(np.concatenate(([0], sentence[1:] != sentence[:-1])))
    own = [w for w in words if w != b"."]
    found = [hashes[inside], *(word_hashes([w[:k] for w in own]) * np.uint64(2 * k + 1) for k in STEMS)]
    order = np.stack(found, axis=1).ravel() >> np.uint64(64 - bits)
    return np.repeat(sentence.astype(np.int64), len(found)), order.astype(np.int64)


def noisy_or(p: np.ndarray) -> float:
    """1 - prod(1 - p); 0 for none."""
    return float(abs(np.expm1(np.log1p(-p.clip(0, 1 - 1e-12)).sum())))


class Model:
    """Word weights and the common offset of all sentences."""

    def __init__(self, weights: np.ndarray, offset: float, bits: int) -> None:
        self.weights, self.offset, self.bits = weights, offset, bits

    def sentences(self, text: bytes | None) -> np.ndarray:
        """The probability of each sentence."""
        sentence, word = sentence_words(text, self.bits)
        z = np.bincount(sentence, self.weights[word]) + self.offset
        return 1 / (1 + np.exp(-z.clip(-50, 50)))

    def document(self, text: bytes | None) -> float:
        return noisy_or(self.sentences(text))


def fit(
    docs: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, y: np.ndarray, share: float, bits: int = BITS,
    steps: int = STEPS, rate: float = RATE,
) -> Model:
    """Train on labels and (sentence, word) arrays of the words that get a weight (AdaGrad, whole batch).

    ``counts`` has the number of sentences of each document, ``share`` that of toxic ones.
    """
    size, sentences = 1 << bits, int(counts.sum())
    offset = float(np.log(max(share, 1e-3) * max(len(y), 1) / max(sentences, 1) + 1e-9))
    weights = np.zeros(size)
    if not len(y) or share in (0.0, 1.0):
        return Model(weights, offset, bits)
    # Sentences are numbered through all documents.
    base = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(docs)), counts)
    sentence = np.concatenate([s + b for (s, _), b in zip(docs, base, strict=False)])
    word = np.concatenate([w for _, w in docs])
    squares, offset_square = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = (np.bincount(sentence, weights[word], minlength=sentences) + offset).clip(-50, 50)
        u = np.bincount(owner, np.logaddexp(0, z), minlength=len(docs))
        # Log likelihood: log(1 - e^-u) of toxic documents, -u of the others.
        by_u = np.where(y == 1, -1 / np.expm1(u.clip(1e-6, 50)), 1.0) / len(y)
        by_z = by_u[owner] / (1 + np.exp(-z))
        slope = np.bincount(word, by_z[sentence], minlength=size)
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
        offset_slope = by_z.sum()
        offset_square += offset_slope**2
        offset -= 0.1 * rate * offset_slope / np.sqrt(offset_square)
    return Model(weights, offset, bits)


def telling_words(rows: DataFrame, bits: int, least: int, sure: float) -> tuple[np.ndarray, float]:
    """Mask of the hashed words and stems that get a weight, and the share of toxic documents.

    Tasks count documents per hashed word; their counts are added up by Spark, at most
    one row per weight.
    """
    size = 1 << bits

    def run(batches):
        seen, toxic, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = np.unique(sentence_words(text, bits)[1])
                seen[words] += 1
                toxic[words] += y == 1
                total += (1, y == 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total[0])), pa.array(np.append(toxic[at], total[1]))],
            ["word", "seen", "toxic"],
        )

    counted = rows.mapInArrow(run, "word long, seen long, toxic long").groupBy("word")
    got = counted.agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    word, seen, toxic = (got[c].to_numpy() for c in ("word", "seen", "toxic"))
    known = np.zeros(size, bool)
    docs, bad = int(seen[word == -1].sum()), int(toxic[word == -1].sum())
    share = bad / docs if docs else 0.0
    error = np.sqrt(seen * share * (1 - share))
    chosen = (word >= 0) & (seen >= least) & (toxic - seen * share > sure * error)
    known[word[chosen]] = True
    return known, share


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, folds: int = FOLDS, least: int = LEAST,
    sure: float = SURE,
) -> Model:
    """Fit on the labelled sample; of its texts only the words with a weight leave the tasks."""
    rows = stored(labelled_sample(docs, labels, "toxic", sample, folds), "toxicity-sample")
    known, share = telling_words(rows, bits, least, sure)
    kept = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            counts, sentences, words = [], [], []
            for text in byte_texts(batch.column(1)):
                sentence, word = sentence_words(text, bits)
                hit = kept.value[word]
                counts.append(int(sentence[-1]) + 1 if len(sentence) else 0)
                sentences.append(sentence[hit].astype(np.int32))
                words.append(word[hit].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int32()),
                 pa.array(sentences, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))],
                ["doc_id", "y", "n", "sentence", "word"],
            )

    kind = "doc_id long, y int, n int, sentence array<int>, word array<int>"
    got = rows.mapInArrow(run, kind).toArrow().sort_by("doc_id")
    pairs = [
        (np.asarray(s.values.to_numpy(), np.int64), np.asarray(w.values.to_numpy(), np.int64))
        for s, w in zip(got["sentence"], got["word"], strict=True)
    ]
    return fit(pairs, got["n"].to_numpy(), got["y"].to_numpy(), share, bits)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, cut: float = 0.5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst) of every document.

    ``worst`` is the number of its most toxic sentence, from 0; null without sentences.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, **options))

    def run(batches):
        for batch in batches:
            scores, worst = [], []
            for text in byte_texts(batch.column(1)):
                p = model.value.sentences(text)
                scores.append(noisy_or(p))
                worst.append(int(p.argmax()) if len(p) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.int32())],
                ["doc_id", "score", "worst"],
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, worst int")
    return scored.select(
        "doc_id", held_out("doc_id", folds, 0).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"), "worst",
    )


def offending_sentences(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **options) -> DataFrame:
    """(doc_id, sentence, score, text) of every sentence scored ``cut`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                p = model.value.sentences(text)
                if len(p) and p.max() >= cut:
                    parts = [s for s in _SENTENCE.findall(text) if s.translate(_TABLE).split()]
                    out += [(doc, i, float(p[i]), parts[i].decode().strip()) for i in np.flatnonzero(p >= cut).tolist()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "sentence", "score", "text"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence int, score double, text string")
