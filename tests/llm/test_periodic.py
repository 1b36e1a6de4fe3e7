"""Periodic runs against a search over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from llm.conftest import corpus
from poolscope.llm import periodic
from poolscope.llm.words import word_hashes


def brute(words, least=12):
    """All runs by comparing words at every period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def brute_row(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def texts(seed):
    """Random words over small alphabets, repeats of repeats, and Fibonacci words."""
    rng = random.Random(seed)
    out = []
    for _ in range(150):
        alphabet = [f"w{i}" for i in range(rng.choice((1, 2, 2, 3, 4, 9, 200)))]
        words = []
        while len(words) < rng.randint(0, 150):
            piece = [rng.choice(alphabet) for _ in range(rng.randint(1, 14))]
            words += piece * rng.choice((1, 1, 2, 3, 6))
            if rng.random() < 0.3:
                words += words[-rng.randint(1, 40) :]
        out.append(" ".join(words[:260]))
    a, b = ["x"], ["x", "y"]
    while len(b) < 230:
        a, b = b, b + a
    return [*out, " ".join(b), " ".join(["same"] * 300), " ".join(f"u{i}" for i in range(300))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts(seed):
    split = [t.encode().split() for t in texts(seed)]
    sizes = np.array([len(w) for w in split])
    first = np.concatenate([[0], np.cumsum(sizes)])
    start, end, q = periodic.runs(word_hashes([w for t in split for w in t]), np.repeat(np.arange(len(split)), sizes))
    got = [[] for _ in split]
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        t = int(np.searchsorted(first, s, "right")) - 1
        got[t].append((s - int(first[t]), e - s, p))
    for words, found in zip(split, got, strict=True):
        assert sorted(found) == brute(words)


def test_small_chunks_give_the_same(monkeypatch):
    some = [t.encode() for t in texts(9)]
    whole = [x.to_pylist() for x in periodic.of_chunk([t.split() for t in some], 12)]
    monkeypatch.setattr(periodic, "CHUNK_PERIODS", 50)
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 300)
    parts = [periodic.of_chunk(c, 12) for c in periodic.chunks(some)]
    assert len(parts) > 10
    assert [[x for p in parts for x in p[k].to_pylist()] for k in (0, 1)] == whole


def test_query_of_documents(spark, documents):
    rows = [(i, t, None) for i, t, _ in corpus(3) if t is None or len(t) < 9000]
    rows += [(10_000 + i, t, "a") for i, t in enumerate(texts(3))] + [(10_000, "", None), (10_001, "a " * 50, None), (10_001, "a " * 50, None)]
    got = periodic.digests(periodic.periodic_runs(periodic.with_repeats(documents(rows)))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_row(d, t)) for d, t, _ in rows)
    assert sum(r.n_runs > 0 for r in got) > 60 and sum(r.n_runs == 0 for r in got) > 20


def test_empty_table(documents):
    assert periodic.digests(periodic.periodic_runs(periodic.with_repeats(documents([])))).collect() == []


def test_long_text_of_one_word(documents):
    row = periodic.periodic_runs(documents([(4, "ab " * 200_000, "x")])).first()
    assert row.n_words == 200_000 and [tuple(r) for r in row.runs] == [(0, 200_000, 1)] and row.collapsed == "ab"
