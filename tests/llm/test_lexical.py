"""Ranked lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import corpus, prose
from poolscope.llm import lexical

SIGNS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return SIGNS.findall(lowered)


def brute(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // length if length else 10
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(map(repr, out))


def search(spark, documents, docs, items, **more):
    frame = documents([(i, t, "a") for i, t in docs])
    asked = spark.createDataFrame([(i, t, 3, 4) for i, t in items], "item_id long, text string, rank int, score int")
    df = lexical.ranked(frame, asked, **more)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(repr(tuple(r)) for r in df.collect())


def some_items(docs, rng, n=60):
    return [(i, " ".join(rng.sample(((rng.choice(docs)[1] or "") + " none of").split(), 2)) + " " + prose(rng, rng.randint(0, 12))) for i in range(n)]


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"top": 3}), (3, {"block_bytes": 900})])
def test_all_pairs(spark, documents, seed, more):
    rng = random.Random(seed)
    docs = [(i, t) for i, t, _ in corpus(seed) if i is not None]
    items = some_items(docs, rng)
    assert search(spark, documents, docs, items, **more) == brute(docs, items, more.get("top", 10))


def test_odd_rows(spark, documents):
    docs = [(5, "Same text"), (3, "same TEXT"), (3, "same text!"), (None, "same, text"), (8, None), (9, ""), (10, " ?!"), (11, "Ärger_ärger x1"), (12, "long " * 60_000 + "text")]
    items = [(1, "same text"), (1, "same text"), (2, None), (3, "..."), (None, "text text"), (4, "ÄRGER x1"), (5, "unheard"), (6, "ärger")]
    assert search(spark, documents, docs, items) == brute(docs, items)
    assert search(spark, documents, [], items) == [] == search(spark, documents, docs, [])


def test_bounds_rule_out_pairs():
    """Most pairs of items and documents are never opened, and the result is that of all pairs."""
    rng = random.Random(4)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(40)]
    docs = [" ".join(rng.choices(topics[i % 40], k=40)) for i in range(2000)]
    items = lexical.Items([(i, i, " ".join(rng.choices(topics[i % 40], k=8)).encode()) for i in range(80)])
    known = items.vocabulary
    counted = [Counter(known[t] for t in d.encode().split() if t in known) for d in docs]
    weights = np.array([lexical.weight_of(2000, sum(t in c for c in counted)) for t in range(len(known))])
    found = lexical.Search(items, weights, 2000, 80_000, np.zeros(80, np.int64), 10)
    sizes = np.full(2000, 40)
    ends = np.cumsum([len(c) for c in counted])
    pairs = [(t, n) for c in counted for t, n in sorted(c.items())]
    columns = np.array(pairs).T
    found.show(np.arange(2000), sizes, ends, *columns)
    assert found.opened < 0.25 * 80 * 2000
    best = defaultdict(list)
    for i, own in enumerate(items.terms):
        scores = [(-sum(int(weights[t]) * int(lexical.value_of(np.array(c[t]), np.array(40), 2000, 80_000)) for t in own.tolist() if t in c), d) for d, c in enumerate(counted)]
        best[i] = [(d, -s) for s, d in sorted(scores)[:10]]
    got = defaultdict(list)
    for i, d, s in zip(found.order[found.item].tolist(), found.doc.tolist(), found.score.tolist(), strict=True):
        got[i].append((d, s))
    assert got == best
