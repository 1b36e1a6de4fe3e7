"""Near copies, substrings and mixing against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import corpus
from poolscope.llm import jaccard, mixing, substrings
from poolscope.llm.tables import components


def brute_components(rows, percent=75):
    sets, root = {}, {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both and 100 * both >= percent * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,percent", [(7, 75), (8, 75), (9, 60)])
def test_jaccard_components(documents, seed, percent):
    rows = corpus(seed)
    got = jaccard.jaccard_components(documents(rows), percent=percent).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_ignores_the_counts_of_the_sketch(documents):
    """Crowded cells change the order, not the result."""
    rows = corpus(11)
    small = jaccard.jaccard_components(documents(rows), sketch_bits=16).collect()
    assert {r.doc_id: r.component_id for r in small if r.doc_id is not None} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_sketches_lose_no_link(spark):
    """Sets on both sides of the threshold: linked ones are always close, most of the others are not."""
    rng = np.random.default_rng(5)
    rows, links = [], []
    for k in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop, more = rng.integers(0, max(1, len(a) // 3), 2)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        links.append(100 * both >= 75 * (len(a) + len(b) - both))
        rows.append((k, len(a), *jaccard.parities(a).tolist(), len(b), *jaccard.parities(b).tolist()))
    names = ["k", *[p + c for p in ("x_", "y_") for c in ("n", *jaccard.WORDS)]]
    df = spark.createDataFrame(rows, names).select("k", jaccard.close("x_", "y_", 75).alias("close"))
    close = [r.close for r in df.orderBy("k").collect()]
    assert all(c for c, link in zip(close, links, strict=True) if link) and 50 < sum(links) < 350
    assert sum(c for c, link in zip(close, links, strict=True) if not link) < 0.5 * (len(rows) - sum(links))


def test_jaccard_without_broadcasts(documents, monkeypatch):
    from poolscope.llm import tables

    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    rows = corpus(12)
    got = jaccard.jaccard_components(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_jaccard_empty_and_repeated(documents):
    assert jaccard.jaccard_components(documents([])).collect() == []
    got = jaccard.jaccard_components(documents([(4, "a b", "x"), (4, "a b", "x"), (2, "A B", None), (9, "", "x")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (4, 2), (4, 2), (9, 9)]


def test_prefix_order_is_total():
    levels = np.zeros(1 << 16, np.uint8)
    levels[:100] = 3
    order = jaccard.TokenOrder(levels, 5)
    tokens = jaccard.shingles(("w%d " * 300 % tuple(range(300))).encode())
    first, level = order.prefix(tokens, len(tokens))
    assert sorted(first.tolist()) == sorted(tokens.tolist()) and (np.diff(level.astype(int)) >= 0).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 130))]
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def brute_substrings(rows, window):
    first = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = Counter()
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window,gram", [(50, 12), (20, 5)])
def test_substrings(documents, window, gram):
    rows = corpus(3) + [(6, corpus(3)[2][1], "a")]
    rows = list({r[0]: r for r in rows if r[0] is not None}.values()) + [r for r in rows if r[0] is None]
    got = Counter(map(tuple, substrings.kept_digests(documents(rows), window, gram).collect()))
    want = brute_substrings(rows, window)
    assert got == want and sum(k[2] for k in want) > 0


def test_substrings_empty_and_repeated(documents):
    assert substrings.kept_digests(documents([])).collect() == []
    text = " ".join(map(str, range(60)))
    got = substrings.kept_digests(documents([(1, text, "a"), (2, text, "a"), (2, text, "a")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 60), (2, 60)]


def targets_by_rounds(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / w for s in open_} if w else {}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_mixing(documents):
    rows = corpus(5) + [(900 + i, "x " * (i % 4), "tiny") for i in range(6)]
    got = mixing.mixture(documents(rows), shard_words=64).collect()
    assert len(got) == len(rows)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(word.findall(t or ""))) for i, t, _ in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = targets_by_rounds(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK * (1 + sizes[s] // 64) ** 0.5 + mixing.BLOCK
    again = mixing.mixture(documents(rows[::-1]).repartition(5), shard_words=64).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_empty_and_wordless(documents):
    assert mixing.mixture(documents([])).collect() == []
    got = mixing.mixture(documents([(1, None, "a"), (2, "", None)])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]


def test_sainte_lague(spark):
    from pyspark.sql import functions as F

    for seats, votes in ((10, [53, 24, 23]), (7, [1, 1, 1, 1, 1]), (100, [0, 5, 1000, 3, 77, 2]), (0, [3, 4])):
        rows = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)], "g string, k int, v long, s long")
        got = {r.k: r.n for r in mixing.apportioned(rows, ["g"], [F.col("k")], "v", "s", "n").collect()}
        order = sorted(((-v / (2 * j + 1), i, j) for i, v in enumerate(votes) if v for j in range(seats)))[:seats]
        assert [got[i] for i in range(len(votes))] == [sum(1 for _, k, _ in order if k == i) for i in range(len(votes))]


def test_mixed_documents_keep_columns(documents):
    docs = documents(corpus(6))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and not out.isEmpty()
    assert out.select("doc_id", "text").distinct().join(docs, ["doc_id", "text"], "left_anti").filter("doc_id is not null and text is not null").isEmpty()
