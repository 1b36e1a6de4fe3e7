"""Classifiers, language model, neighbours and line dedup."""

import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from llm.conftest import corpus, prose
from poolscope.llm import language_model, lines, neighbours, quality, toxicity

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def labelled(seed=2, n=400):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        toxic, junk = i % 5 == 0, i % 7 == 0
        sentences = [prose(rng, 8) for _ in range(6)]
        if toxic:
            sentences[rng.randrange(6)] += rng.choice((" vilestuff", " nastyword vilestuff"))
        text = " | ".join(prose(rng, 30).split()) if junk else ". ".join(sentences) + "."
        rows.append((i, text + (" vilestuff" if junk and toxic else ""), "s"))
        marks.append((i, int(not junk), int(toxic)))
    return rows, marks


@pytest.mark.parametrize("score,label,cut", [(toxicity.toxicity, 2, 0.5), (quality.quality, 1, 0.3)])
def test_classifiers_on_held_out_rows(documents, labels, score, label, cut):
    rows, marks = labelled()
    odd = [(None, "a b", None), (5000, None, "s"), (5001, "", "s"), (5002, "long " * 20000, "s")]
    got = score(documents(rows + odd), labels(marks + [(None, 1, 1), (3, None, None), (4, 0, 1)])).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {m[0]: m[label] for m in marks}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 4]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 50


def test_labels_of_held_out_rows_are_not_learnt(documents, labels):
    rows, marks = labelled(n=120)
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in marks]
    for score in (toxicity.toxicity, quality.quality):
        a, b = (sorted((r.doc_id, r.score) for r in score(documents(rows), labels(m)).collect()) for m in (marks, turned))
        assert a == b


def test_classifiers_without_rows(documents, labels):
    for score in (toxicity.toxicity, quality.quality):
        assert score(documents([]), labels([])).collect() == []
        assert all(0 <= r.score <= 1 for r in score(documents([(1, "a. b", "s"), (2, None, "s")]), labels([])).collect())


def test_offending_sentences(documents, labels):
    rows, marks = labelled()
    found = toxicity.offending_sentences(documents(rows), labels(marks)).collect()
    hit = [r for r in found if "vilestuff" in r.text]
    assert len(hit) >= 0.9 * sum(m[2] for m in marks) and len(hit) >= 0.95 * len(found)


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95 and (0, 1) in [(a, b) for a, b, _ in model.pairs]
    one = model.offset + sum(t[np.searchsorted(e, x[0, f], "right")] for f, (t, e) in enumerate(zip(model.single, model.edges)))
    at = model.bins(x[:1])[0]
    one += sum(t[model.coarse[a][at[a]], model.coarse[b][at[b]]] for a, b, t in model.pairs)
    assert abs(one - model.total(model.bins(x[:1]))[0]) < 1e-9


@pytest.mark.parametrize("frequent", [1 << 20, 300])
def test_language_model_counts(documents, frequent):
    rows = corpus(4) + [(7, "Kan KAN unseenword", "a"), (7, "Kan KAN unseenword", "a")]
    got = language_model.scores(documents(rows), frequent=frequent).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t, _ in rows:
        if i is not None and not held(i):
            counts.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        want.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    mine = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]
    for a, b in zip(sorted(mine), sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
    assert all(r.score < 0 for r in got)


def test_language_model_is_normalised():
    model = language_model.LogBilinear(np.full(language_model.CLASSES, 1 / language_model.CLASSES))
    before = np.array([[3, 4, 5]] * language_model.CLASSES)
    assert abs((10 ** model.log10(before, np.arange(language_model.CLASSES))).sum() - 1) < 1e-5
    copy = language_model.LogBilinear(model.share, seed=2)
    copy.put(model.flat())
    assert (copy.flat() == model.flat()).all()


def test_language_model_without_rows(documents):
    assert language_model.scores(documents([])).collect() == []
    got = language_model.scores(documents([(None, "a b", None)])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_language_model_learns_from_every_training_token(documents, monkeypatch):
    rows, learnt, train = corpus(6), [], language_model.trained
    monkeypatch.setattr(language_model, "trained", lambda *a: learnt.append(train(*a)) or learnt[-1])
    got = language_model.scores(documents(rows)).collect()
    mine = [r for r in got if r.doc_id is not None and not r.held_out]
    assert sum(m.learnt for m in learnt) == sum(r.n_tokens for r in mine) == got[0].train_tokens


@needs_data
def test_language_model_beats_counts(spark):
    got = language_model.scores(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_recall(spark, scaled):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(1500, 16)) * (rng.random((1500, 1)) * 3 + 0.1 if scaled else 1)
    rows[200:700] = rows[20]
    rows = rows.astype(np.float32)
    full = [(i, [float(x) for x in v], 0.0) for i, v in enumerate(rows)]
    odd = [(2000, None, 0.0), (2020, [0.0] * 16, 0.0), (2040, [float("nan")] * 16, 0.0), (2060, [None] * 16, 0.0),
           (2080, [1.0], 0.0), (None, full[0][1], 0.0), full[40], (2100, [], 0.0)]
    data = vectors(spark, full + odd)
    got = neighbours.nearest(data, neighbours.every_twentieth(data), sample=1000, share=2.0).collect()
    exact, hit = rows.astype(float) @ rows[::20].astype(float).T, 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        column = exact[:, q // 20]
        for r in found:
            assert r.vec_id != q and abs(r.score - column[r.vec_id]) < 1e-9
        best = sorted((-s, i) for i, s in enumerate(column) if i != q)[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in found})
    assert hit >= 0.9 * 20 * len(by)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_neighbours_recall_of_the_defaults(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    held = data.select("vec_id", "embedding").toArrow()
    ids, rows = held["vec_id"].to_numpy(), np.stack(held["embedding"].to_numpy(zero_copy_only=False)).astype(float)
    by, hit, asked = {}, 0, np.flatnonzero(ids % neighbours.QUERY_STEP == 0)
    for r in neighbours.nearest(data, neighbours.every_twentieth(data)).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q in asked:
        order = np.lexsort((ids, -(rows @ rows[q])))
        hit += len(by[ids[q]] & set(ids[order[ids[order] != ids[q]]][: neighbours.TOP].tolist()))
    assert hit >= 0.98 * neighbours.TOP * len(asked)


def test_neighbours_few_and_none(spark):
    assert neighbours.nearest(vectors(spark, []), vectors(spark, [])).collect() == []
    data = vectors(spark, [(0, [1.0, 0.0], 0.0), (1, [1.0, 0.0], 0.0), (3, [0.0, 2.0], 0.0)])
    got = neighbours.nearest(data, neighbours.every_twentieth(data)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 3, 0.0)]


PAGE_ROWS = [
    (1, "http://a.org/1", "<p>menu</p><p>one</p><script>x<p>y</p></script>"), (2, "https://u@A.ORG:80/2", "<div>menu<br>two</div><!-- <p>menu</p> -->"),
    (3, "http://a.org/3", "<p>three</p>\n<p> menu </p>"), (4, "http://a.org", None), (5, "http://a.org/5", "<p>menu</p><p>menu</p>"),
    (6, "http://b.org/1", "<p>menu</p>"), (7, None, "<p>menu</p>"), (8, "no url", "<b>menu</b> x"), (5, "http://a.org/5", "<p>menu</p><p>menu</p>"),
]


def test_line_dedup(spark):
    pages = spark.createDataFrame([(*r, "x") for r in PAGE_ROWS], "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in lines.without_boilerplate(pages).collect())
    assert [(r[0], r[1] or "", r[2], r[3], r[4]) for r in sorted(got, key=lambda r: r[0])] == [
        (1, "a.org", 2, 1, "one"), (2, "a.org", 2, 1, "two"), (3, "a.org", 2, 1, "three"), (4, "a.org", 0, 0, ""), (5, "a.org", 2, 2, ""),
        (5, "a.org", 2, 2, ""), (6, "b.org", 1, 0, "menu"), (7, "", 1, 0, "menu"), (8, "", 1, 0, "menu x")]
    assert lines.without_boilerplate(pages.limit(0)).collect() == []


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGE_ROWS)
    pages = spark.createDataFrame(PAGE_ROWS, "page_id long, url string, html string")
    want = con.execute(lines.check_sql()).fetchall()
    assert sorted(map(repr, (tuple(r) for r in lines.without_boilerplate(pages).collect()))) == sorted(map(repr, want))


def test_line_dedup_keeps_lines_of_one_page(spark):
    """Hosts of 1 to 6 pages: only the shared line goes."""
    rows = [(10 * n + i, f"http://h{n}.org/{i}", f"<p>menu</p><p>own {i}</p>") for n in range(1, 7) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in lines.without_boilerplate(pages).collect():
        n, i = divmod(r.page_id, 10)
        assert r.text == (f"own {i}" if n >= 3 else f"menu\nown {i}")
