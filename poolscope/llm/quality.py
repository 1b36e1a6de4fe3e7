"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers (lengths, repetition, kinds of characters). Each
number is cut into at most ``BINS`` quantile bins. Cyclic boosting visits the
features in turn, round after round, and adds a shallow tree (at most three cuts on
the bins of that one feature) fitted to the current residuals at a small rate; the
trees of a feature add up to one lookup table. Then the ``PAIRS`` feature pairs that
explain most of what is left on a coarse grid get two-dimensional tables, boosted
in the same cyclic way by trees with one cut per axis. A score is the logistic
function of the tables' entries added up, by indexing whole batches.

The model is fitted on at most ``SAMPLE`` labelled rows; all rows are scored.

Defined results: null and empty texts have all numbers 0 and are scored by the same
tables. Null ids are scored and never learnt from. Repeated rows score alike. No usable
labels: every score is 0.5. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.labelled import FOLDS, SAMPLE, labelled_sample
from poolscope.llm.tables import held_out
from poolscope.llm.words import byte_texts

BINS = 32
COARSE = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.1
STEADY = 1.0

FEATURES = (
    "log_words", "mean_word", "distinct_words", "top_word", "repeated_pairs", "short_words", "log_lines",
    "repeated_lines", "upper", "digits", "sentence_marks", "symbols", "pipes", "symbol_words", "beyond_ascii",
)

# Kinds of bytes: 0 other, 1 blank, 2 upper, 3 lower, 4 digit, 5 sentence mark, 6 symbol, 7 pipe, 8 beyond ASCII.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 2, 3, 4, 8
_KINDS[list(b".,;:!?'\"-()")] = 5
_KINDS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = 6
_KINDS[ord("|")] = 7


def numbers(text: bytes | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=9)
    size = len(text) - int(kinds[1])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    marked = sum(w[-1] in b"!#$%&*|" for w in words)
    return [
        float(np.log1p(n)), size / n, len(counts) / n, max(counts.values()) / n, 1 - pairs / max(n - 1, 1) if n > 1 else 0.0,
        float((lengths <= 3).mean()), float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines),
        kinds[2] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size, marked / n, kinds[8] / size,
    ]


class Tables:
    """Bin edges, the lookup table of each feature, and those of the pairs."""

    def __init__(self, edges: list[np.ndarray], offset: float) -> None:
        self.edges, self.offset = edges, offset
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.coarse = [np.minimum(np.arange(len(e) + 1) * COARSE // (len(e) + 1), COARSE - 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)])

    def total(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.offset)
        for f, table in enumerate(self.single):
            out += table[bins[:, f]]
        for a, b, table in self.pairs:
            out += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.total(self.bins(x)).clip(-50, 50)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + STEADY)


def shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = 3) -> np.ndarray:
    """Leaf values over the bins: greedy cuts where the gain is greatest."""
    bounds = [0, len(g)]
    sums = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    for _ in range(cuts):
        best = (1e-9, 0)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            at = np.arange(lo + 1, hi)
            if len(at):
                (gl, gr), (hl, hr) = ((s[at] - s[lo], s[hi] - s[at]) for s in sums)
                gain = _gain(gl, hl) + _gain(gr, hr) - _gain(sums[0][hi] - sums[0][lo], sums[1][hi] - sums[1][lo])
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(at[gain.argmax()]))
        if not best[1]:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out[lo:hi] = (sums[0][hi] - sums[0][lo]) / (sums[1][hi] - sums[1][lo] + STEADY)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values over a grid cut once per axis where the gain is greatest, and that gain."""
    gs, hs = (np.zeros((COARSE + 1, COARSE + 1)) for _ in range(2))
    gs[1:, 1:], hs[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(s: np.ndarray) -> list[np.ndarray]:
        a, b, c = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1]
        return [a, b - a, c - a, s[-1, -1] - b - c + a]

    gq, hq = quarters(gs), quarters(hs)
    gain = sum(_gain(x, y) for x, y in zip(gq, hq, strict=True)) - _gain(gs[-1, -1], hs[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [float(x[i, j] / (y[i, j] + STEADY)) for x, y in zip(gq, hq, strict=True)]
    out = np.empty((COARSE, COARSE))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS,
        pairs: int = PAIRS, rate: float = RATE) -> Tables:
    """Boost the tables on features ``x`` and labels ``y`` (0 or 1)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], cuts)) if len(y) else np.zeros(0) for f in range(len(FEATURES))]
    model = Tables(edges, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    at = model.bins(x)
    total = np.full(len(y), model.offset)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.single):
            g, h = (np.bincount(at[:, f], s, minlength=len(table)) for s in slopes())
            step = rate * shallow_tree(g, h)
            table += step
            total += step[at[:, f]]

    cells = {}
    for a in range(len(FEATURES)):
        for b in range(a + 1, len(FEATURES)):
            cells[a, b] = model.coarse[a][at[:, a]] * COARSE + model.coarse[b][at[:, b]]

    def grid(cell: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(cell, s, minlength=COARSE**2).reshape(COARSE, COARSE) for s in slopes()]

    gains = {pair: cross_tree(*grid(cell))[1] for pair, cell in cells.items()}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    tables = {pair: np.zeros((COARSE, COARSE)) for pair in chosen}
    for _ in range(pair_rounds):
        for pair in chosen:
            step = rate * cross_tree(*grid(cells[pair]))[0]
            tables[pair] += step
            total += step.ravel()[cells[pair]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Tables:
    """Fit on the labelled sample; texts become numbers before they leave the tasks."""
    rows = labelled_sample(docs, labels, "quality", sample, folds)

    def run(batches):
        for batch in batches:
            found = [numbers(t) for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "y", "x"]
            )

    got = rows.mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, cut: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_score(docs.select("doc_id", "text"), labels, folds=folds, **options)
    return scored.select(
        "doc_id", held_out("doc_id", folds, 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= cut).cast("int").alias("predicted"),
    )


def with_score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents with ``_score``; their text is read once more and passed on."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    keep = docs.columns

    def run(batches):
        for batch in batches:
            x = np.array([numbers(t) for t in byte_texts(batch.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.scores(x), pa.float64())], [*keep, "_score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kind}, _score double")


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.3, **options) -> DataFrame:
    """The documents the classifier does not reject, with the columns of ``docs``."""
    return with_score(docs, labels, **options).filter(F.col("_score") >= cut).drop("_score")
