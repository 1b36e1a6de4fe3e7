"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation.

Counts. Words of all training documents are counted, by 64-bit hash, with partial
counts in the tasks and an aggregation. Words at the top of the count order, at most
``FREQUENT`` of them, are sent to all tasks as sorted arrays; counts of the others
meet the (document, word) rows that need them in a join. So every score uses exact
counts while what is broadcast is bounded.

Classes. The ``OWN`` most frequent words are classes of their own, all others share
``ENDINGS`` classes by a hash of their last bytes, and the end of a text is one. The
model predicts the class of the next token from the ``CONTEXT`` classes before it;
inside a class a word has probability (c + 1) / S, where S sums c + 1 over the class's
words plus 1 for an unseen one. The product is normalised over all words.

Model. Log-bilinear: context vectors, weighed by position and dimension, add up to a
prediction; its products with the class vectors, plus a bias that starts at the log
frequency, are the scores. Texts are cut and looked up once and written as class
numbers. The training documents are dealt over the rounds by row number, so every
token of every training document is learnt from in exactly one. In each round, tasks
run gradient steps from the same start on their own part of its documents against
noise drawn from the class frequencies; the results are averaged by positions, as an
aggregation over parameter numbers.

Scoring. Batches of contexts times the class matrix, with the full normaliser.

Defined results: null or empty text: the end token alone. Null ids: scored, not
learnt from (``held_out`` false). Repeated rows score alike and count each. No training
documents: N = V = 0, base scores are 0 and the model is uniform over its classes.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.tables import held_out, stored
from poolscope.llm.words import byte_texts, word_hashes

PARTS, HELD_OUT = 7, 2
FREQUENT = 1 << 20
OWN = 160
ENDINGS = 95
CONTEXT = 3
SIZE = 24
NOISE = 64
RATIO = 16
BATCH = 1024
RATES = (0.3, 0.15)
HELD_WORDS = 300_000
HELD_TOKENS = 1 << 15

CLASSES = OWN + ENDINGS + 1
END = CLASSES - 1


def ending_class(words: list[bytes]) -> np.ndarray:
    """The shared class of words, by their last three bytes."""
    return (OWN + word_hashes([w[-3:] for w in words]) % np.uint64(ENDINGS)).astype(np.int16)


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def learnt_from(docs: DataFrame, parts: int, part: int) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, c): how often each word occurs, words as hashes with their shared class."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def flush():
            words = list(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array(word_hashes(words).view(np.int64)), pa.array(ending_class(words)),
                 pa.array(list(held.values()), pa.int64())], ["word", "ending", "c"],
            )
            held.clear()
            return out

        for batch in batches:
            for text in byte_texts(batch.column(1)):
                held.update(split_words(text))
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(run, "word long, ending short, c long")
    return rows.groupBy("word", "ending").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words as sorted hashes with counts and classes, and sums over all words."""

    def __init__(self, words, counts, classes, class_sums, tokens: int, distinct: int, texts: int) -> None:
        order = np.argsort(words)
        self.words, self.classes = words[order], classes[order]
        self.logs = np.log10(counts[order] + 1.0)
        self.tokens, self.distinct, self.texts = tokens, distinct, texts
        self.base = np.log10(tokens + distinct + 1.0)
        self.sums = np.log10(class_sums)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those not held."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes).clip(0, len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def token_classes(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        """Classes of a text's words and of its end."""
        out = np.full(len(words) + 1, END, np.int16)
        if len(words):
            out[:-1] = self.classes[at] if len(self.words) else 0
            rare = np.flatnonzero(at < 0)
            out[rare] = ending_class([words[i] for i in rare.tolist()])
        return out


def vocabulary(counts: DataFrame, texts: int, frequent: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of a stored table of counts, and the frequency of each class.

    A count limit that at most ``frequent`` words pass is found in sums by count range.
    """
    octave = F.floor(16 * F.log2(F.col("c").cast("double")))
    ranges = counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    tokens, distinct = sum(r.c for r in ranges) + texts, sum(r.n for r in ranges) + (texts > 0)
    lowest, room = float("inf"), frequent
    for r in sorted(ranges, key=lambda r: -r.o):
        if r.n > room:
            break
        lowest, room = r.o, room - r.n
    own = counts.orderBy(F.col("c").desc(), "word").limit(OWN).collect()
    held = counts.filter(octave >= lowest).select("word", "ending", "c").toArrow() if ranges else None
    words = held["word"].to_numpy().view(np.uint64) if held else np.zeros(0, np.uint64)
    c = held["c"].to_numpy() if held else np.zeros(0, np.int64)
    classes = held["ending"].to_numpy().astype(np.int16) if held else np.zeros(0, np.int16)
    # Own classes need a place among the frequent words.
    inside = set(words.view(np.int64).tolist())
    own = [r for r in own if r.word in inside]
    rank = {r.word: i for i, r in enumerate(own)}
    at = np.flatnonzero(np.isin(words.view(np.int64), np.array(list(rank), np.int64)))
    classes = classes.copy()
    classes[at] = [rank[w] for w in words[at].view(np.int64).tolist()]

    sums, mass = np.ones(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        sums[r.ending] += r.c + r.n
        mass[r.ending] += r.c
    for i, r in enumerate(own):
        sums[r.ending] -= r.c + 1
        mass[r.ending] -= r.c
        sums[i], mass[i] = r.c + 1, r.c
    mass[END], sums[END] = texts, texts + 1
    return Vocabulary(words, c, classes, sums, tokens, distinct, texts), (mass + 1) / (mass + 1).sum()


class LogBilinear:
    """Context vectors by class, position weights, class vectors and biases."""

    def __init__(self, share: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32)
        self.position = np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32)
        self.target = rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32)
        self.bias = np.log(share).astype(np.float32)
        self.share = share
        self.learnt = 0
        self.drawn = np.cumsum(share)
        self.offset = np.log(RATIO * share).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.context, self.position, self.target, self.bias)])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("context", "position", "target", "bias"):
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return (self.context[before] * self.position).sum(axis=1)

    def log10(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each class after its context."""
        codes = before.astype(np.int64) @ (CLASSES ** np.arange(CONTEXT))
        # The normaliser is worked out once for equal contexts.
        _, first, place = np.unique(codes, return_index=True, return_inverse=True)
        own, total = self.predicted(before[first]), np.empty(len(first))
        for lo in range(0, len(first), 512):
            scores = own[lo : lo + 512] @ self.target.T
            scores += self.bias
            top = scores.max(axis=1)
            scores -= top[:, None]
            total[lo : lo + 512] = top + np.log(np.exp(scores, out=scores).sum(axis=1))
        out = np.empty(len(token))
        for lo in range(0, len(token), 4096):
            at, to = place[lo : lo + 4096], token[lo : lo + 4096]
            out[lo : lo + 4096] = np.einsum("ij,ij->i", own.take(at, axis=0), self.target.take(to, axis=0)) + self.bias[to] - total[at]
        return out / np.log(10)

    def step(self, before: np.ndarray, token: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One gradient step of noise-contrastive estimation; the noise is shared by the batch."""
        n = len(token)
        noise = np.searchsorted(self.drawn, rng.random(NOISE), "right").clip(0, CLASSES - 1)
        parts = [self.context.take(before[:, j], axis=0) for j in range(CONTEXT)]
        own = sum(p * w for p, w in zip(parts, self.position, strict=True))
        true, false = self.target.take(token, axis=0), self.target[noise]
        data = np.einsum("ij,ij->i", own, true) + self.bias[token] - self.offset[token]
        other = own @ false.T
        other += self.bias[noise] - self.offset[noise]
        up = 1 / (1 + np.exp(data.clip(-30, 30)))
        down = np.exp(-other.clip(-30, 30, out=other))
        down += 1
        np.divide(np.float32(RATIO / NOISE), down, out=down)
        slope = up[:, None] * true - down @ false
        target, bias = by_class(token, own * up[:, None]), np.bincount(token, up, CLASSES).astype(np.float32)
        np.subtract.at(target, noise, down.T @ own)
        np.subtract.at(bias, noise, down.sum(axis=0))
        context = np.zeros_like(self.context)
        position = np.empty_like(self.position)
        for j in range(CONTEXT):
            context += by_class(before[:, j], slope * self.position[j])
            position[j] = np.einsum("ij,ij->j", slope, parts[j])
        step = rate * 16 / n
        self.target += step * target
        self.bias += step * bias
        self.context += step * context
        self.position += step * position / CONTEXT


def by_class(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each class."""
    order = np.argsort(classes, kind="stable")
    counts = np.bincount(classes, minlength=CLASSES)
    held = np.flatnonzero(counts)
    out = np.zeros((CLASSES, rows.shape[1]), np.float32)
    out[held] = np.add.reduceat(rows.take(order, axis=0), np.cumsum(counts)[held] - counts[held])
    return out


def contexts(classes: np.ndarray) -> np.ndarray:
    """The classes before each token, the nearest first; ends stand before a text."""
    padded = np.concatenate([np.full(CONTEXT, END, np.int16), classes])
    return np.stack([padded[CONTEXT - 1 - j : len(padded) - 1 - j] for j in range(CONTEXT)], axis=1)


ROWS = "row long, doc_id long, n_tokens long, n_known long, base double, inside double, classes binary, word long, times long"
SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double"


def looked_up(docs: DataFrame, words) -> DataFrame:
    """A row per document with its class numbers, and one per word the vocabulary does not hold."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = (*[pa.int64()] * 4, *[pa.float64()] * 2, pa.binary(), pa.int64(), pa.int64())

    def run(batches):
        known = words.value
        row = TaskContext.get().partitionId() << 33
        ends = np.log10(known.texts + 1.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                out = []
                for doc, text in zip(piece.column(0).to_pylist(), byte_texts(piece.column(1)), strict=True):
                    split = split_words(text)
                    hashes = word_hashes(split)
                    at = known.find(hashes)
                    classes = known.token_classes(split, at)
                    held = at >= 0
                    logs = float(known.logs[at[held]].sum()) + ends
                    inside = logs - float(known.sums[classes].sum())
                    n = len(split) + 1
                    seen = int(held.sum()) + (known.texts > 0)
                    out.append((row, doc, n, seen, logs - n * known.base, inside, classes.astype(np.uint8).tobytes(), None, None))
                    if not held.all():
                        rare, times = np.unique(hashes[~held], return_counts=True)
                        rare = rare.view(np.int64).tolist()
                        out += [(row, *[None] * 6, w, t) for w, t in zip(rare, times.tolist(), strict=True)]
                    row += 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, ROWS)


def class_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).astype(np.int16)


def trained(rows: DataFrame, model: LogBilinear, rate: float) -> LogBilinear:
    """One round: tasks train from ``model`` on all tokens of their rows, results are averaged."""
    spark = rows.sparkSession
    start = spark.sparkContext.broadcast(model)

    def run(batches):
        own = LogBilinear(start.value.share)
        own.put(start.value.flat())
        rng = np.random.default_rng(TaskContext.get().partitionId())
        before, token, held, seen = [], [], 0, 0

        def learn():
            b, t = np.concatenate(before), np.concatenate(token)
            mixed = rng.permutation(len(t))
            for lo in range(0, len(t), BATCH):
                some = mixed[lo : lo + BATCH]
                # A short batch steps by its own size.
                own.step(b[some], t[some], rng, rate * len(some) / BATCH)

        for batch in batches:
            for data in batch.column(0):
                classes = class_numbers(data.as_py())
                before.append(contexts(classes))
                token.append(classes)
                held += len(classes)
                if held >= HELD_TOKENS:
                    learn()
                    before, token, seen, held = [], [], seen + held, 0
        if held:
            learn()
            seen += held
        if seen:
            flat = own.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.int64))],
                ["i", "x", "n"],
            )

    got = (
        rows.select("classes").mapInArrow(run, "i int, x double, n long")
        .groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    )
    out = LogBilinear(model.share)
    out.put(model.flat())
    if got.num_rows:
        flat = model.flat().astype(np.float64)
        flat[got["i"].to_numpy()] = got["x"].to_numpy() / got["n"].to_numpy()
        out.put(flat)
        out.learnt = got["n"][0].as_py()
    return out


def scores(
    docs: DataFrame, parts: int = PARTS, part: int = HELD_OUT, frequent: int = FREQUENT,
    rates: tuple[float, ...] = RATES,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learnt = learnt_from(docs, parts, part)
    counts = stored(word_counts(learnt), "language-counts")
    found, share = vocabulary(counts, learnt.count(), frequent)
    rows = stored(looked_up(docs, spark.sparkContext.broadcast(found)), "language-classes")
    texts = rows.filter("word is null")
    model = LogBilinear(share)
    for turn, rate in enumerate(rates):
        mine = learnt_from(texts, parts, part).filter(F.col("row") % len(rates) == turn)
        model = trained(mine, model, rate)
    final = spark.sparkContext.broadcast(model)

    def run(batches):
        net = final.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                token = [class_numbers(x.as_py()) for x in piece.column(6)]
                logs = net.log10(np.concatenate([contexts(t) for t in token]), np.concatenate(token))
                sums = np.add.reduceat(logs, np.cumsum([0, *map(len, token[:-1])]))
                score = piece.column(5).to_numpy() + sums
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:5], pa.array(score)], [x.split()[0] for x in SCORED.split(", ")]
                )

    late = (
        rows.filter("word is not null").select("row", "word", "times").join(counts.select("word", "c"), "word")
        .groupBy("row").agg(
            F.sum("times").alias("late"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs")
        )
    )
    given = texts.drop("word", "times").mapInArrow(run, SCORED)
    return given.join(late, "row", "left").select(
        "doc_id", held_out("doc_id", parts, part).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("late", F.lit(0))).alias("n_known"),
        F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
