"""Token files, decontamination and the pipeline."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm.conftest import corpus, prose
from poolscope.llm import decontamination as dc
from poolscope.llm import mixing, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 700):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = tokens.packed(ids, bits)
        assert len(data) == -(-n * bits // 8) and (tokens.unpacked(data, bits, 0, n) == ids).all()
        if n > 600:
            assert (tokens.unpacked(data, bits, 70, 333) == ids[70:333]).all()


def test_words_encode_like_texts():
    path = tokens.tokenizer_path()
    whole, by_word = Tokenizer.from_file(path), tokens.Encoder(path, True)
    rng = random.Random(1)
    parts = [*"aAbZ09.,!'\"<|>éÉßİΣς ٣  \x1c\x85\n\t中文😀é-_", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "A.B.,", ".,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [prose(rng, 20).swapcase() + "." for _ in range(50)] + ["WORD,", "k" * 400]
    for text, ids in zip(texts, by_word.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_forgotten_and_learnt_again(monkeypatch):
    path = tokens.tokenizer_path()
    texts = [prose(random.Random(i), 30).encode() for i in range(40)]
    want = tokens.Encoder(path, False).ids(texts)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 7)
    few = tokens.Encoder(path, True)
    assert [few.ids([t])[0] for t in texts] == want and len(few.words) <= 80


def test_new_words_cost_no_pass_over_the_remembered_ones():
    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("went through all remembered words")

        keys = items = values = __iter__

    path = tokens.tokenizer_path()
    texts = [prose(random.Random(i), 30).encode() + b" x%d." % i for i in range(6)]
    encoder = tokens.Encoder(path, True)
    encoder.words, encoder.parts = Remembered(encoder.words), Remembered(encoder.parts)
    assert [encoder.ids([t])[0] for t in texts] == tokens.Encoder(path, False).ids(texts)


def test_token_file(spark, documents, tmp_path):
    rows = corpus(2)
    docs, path, target = documents(rows).repartition(3), tokens.tokenizer_path(), str(tmp_path / "file")
    tokens.write_tokens(docs, target, path, tokens.VOCABULARY, block=512, by_word=True)
    blocks = tokens.read_tokens(spark, target)
    got = sorted(tokens.digests(blocks).collect(), key=lambda r: r.start)
    whole, at = Tokenizer.from_file(path), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, text, _) in zip(got, order, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = {r.doc_id: r.ids for r in tokens.documents_of(blocks, [9, 30]).collect()}
    texts = {i: t for i, t, _ in rows}
    assert some == {i: [*whole.encode(texts[i], add_special_tokens=False).ids, 1] for i in (9, 30)}
    tokens.write_tokens(docs, str(tmp_path / "whole"), path, tokens.VOCABULARY)
    again = tokens.digests(tokens.read_tokens(spark, str(tmp_path / "whole"))).collect()
    assert sorted(again, key=lambda r: r.start) == got
    tokens.write_tokens(documents([]), str(tmp_path / "none"), path, tokens.VOCABULARY)
    assert tokens.digests(tokens.read_tokens(spark, str(tmp_path / "none"))).collect() == []


def brute_overlaps(text, item, share, least):
    a, b = dc.plain_words(text.encode()), dc.plain_words(item.encode())
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), shift + len(b))
        equal = a[lo:hi] == b[lo - shift : hi - shift]
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                if equal[i:j].mean() >= share and j - i > best:
                    best = j - i
    return best if best >= min(least, len(b)) else 0


def test_longest_stretch():
    rng = np.random.default_rng(3)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 30)) < 0.7
        lo, hi = dc.longest_stretch(equal, 0.75)
        best = max((j - i for i in range(len(equal)) for j in range(i, len(equal) + 1) if equal[i:j].sum() >= 0.75 * (j - i)), default=0)
        assert hi - lo == best and equal[lo:hi].sum() >= 0.75 * (hi - lo)


def test_decontamination(spark, documents):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice((3, 9, 14, 30, 55)))) for i in range(20)] + [(20, None), (3, "a b c d e f g h i j k l m")]
    rows = [(i, prose(rng, 40), "s") for i in range(20)] + [(50, None, "s"), (51, "", "s"), (52, prose(rng, 8000), "s"), (None, items[5][1], "s")]
    planted = {}
    for n, (i, text) in enumerate(items[:20]):
        if len(text.split()) >= 9:
            words = text.upper().split() if n % 2 else text.split()
            for k in range(4, len(words), 7 if n % 3 else 1000):
                words[k] = "changed"
            rows.append((100 + i, prose(rng, 15) + ", " + " ".join(words) + "! " + prose(rng, 15), "s"))
            planted[100 + i] = i
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    for words in (1_000_000, 40):
        got = dc.contaminated(documents(rows), benchmark, block_words=words).collect()
        found = {(r.doc_id, r.item_id) for r in got}
        assert {(d, i) for d, i in planted.items()} <= found
        assert all(d is None or d >= 100 for d, _ in found)
    short = {r.doc_id: r for r in got}
    for d, i in list(planted.items())[:3]:
        text = next(t for k, t, _ in rows if k == d)
        assert short[d].n_words == brute_overlaps(text, items[i][1], dc.SHARE, dc.LEAST)
    clean = dc.clean_documents(documents(rows), benchmark)
    assert clean.columns == documents(rows).columns
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} == {r[0] for r in rows if r[0] is not None} - set(planted)
    dirty = next(t for k, t, _ in rows if k == min(planted))
    odd = [(None, dirty, "s"), (None, "kept words", "s"), (7, dirty, "s"), (7, "other words", "s"), (8, None, "s")]
    left = dc.clean_documents(documents(odd), benchmark).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.text) == [("7", "other words"), ("None", "kept words")] and len(left) == 3
    assert dc.clean_documents(documents([]), benchmark).collect() == []
    assert dc.contaminated(documents([]), benchmark).collect() == [] == dc.contaminated(documents(rows), benchmark.limit(0)).collect()


@pytest.mark.parametrize("size", range(8, 25))
def test_masks_hit_every_arrangement(size):
    """However a quarter of the words is replaced, some mask sees equal words only."""
    spots = list(itertools.combinations(range(size), size // 4))
    equal = np.ones((len(spots), size), bool)
    equal[np.arange(len(spots))[:, None], spots] = False
    hit = np.zeros(len(spots), bool)
    for mask in dc.MASKS:
        looked = np.array([x == "1" for x in mask])
        for at in range(size - len(mask) + 1):
            hit |= equal[:, at : at + len(mask)][:, looked].all(axis=1)
    assert hit.all()


def test_decontamination_finds_all_overlaps(spark, documents):
    """Random and every-fourth replacements, against brute force over all pairs."""
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice((5, 7, 8, 9, 12, 16, 20, 24)))) for i in range(24)]
    rows = [(900, prose(rng, 60), "s")]
    for i, text in items:
        for turn in range(3):
            words = text.split()
            gone = range(3, len(words), 4) if turn == 2 else rng.sample(range(len(words)), len(words) // 4 + turn)
            for k in gone:
                words[k] = "changed"
            rows.append((10 * i + turn, prose(rng, 6) + " " + " ".join(words) + " " + prose(rng, 6), "s"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in dc.contaminated(documents(rows), benchmark).collect()}
    want = {
        (d, i): n for d, text, _ in rows for i, item in items
        if len(item.split()) >= dc.SHORTEST and (n := brute_overlaps(text, item, dc.SHARE, dc.LEAST))
    }
    assert got == want and len(want) > 30


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, docs = docs, out
        if name == "n-gram Jaccard join":
            from llm.test_pairs import brute_components

            rows = [(r.doc_id, r.text, None) for r in before.collect()]
            roots = brute_components(rows)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in roots.items() if i == c}
        if name == "mixing sources to target weights":
            times = {r.doc_id: r["first"] for r in mixing.mixture(before).collect()}
            got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert got == {i: n for i, n in times.items() if n}
    last = seen["token-ID / binary output"].orderBy("start").collect()
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in last) and len(last) == seen["mixing sources to target weights"].count()


def test_pipeline_keeps_one_of_repeated_rows(spark, documents):
    text = prose(random.Random(1), 40)
    docs = documents([(5, text, "a"), (5, text, "a"), (9, text, "b"), (None, text, "c"), (11, "", "a"), (12, None, "a")])
    out = corpus_pipeline.jaccard_stage(spark, docs, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 5), (False, 11), (False, 12), (True, 0)]


def test_pipeline_tells_texts_of_one_id_apart(spark, documents):
    rng = random.Random(2)
    shared, own, other = prose(rng, 80), prose(rng, 60), prose(rng, 60)
    near = shared.split()
    near[40] = "changed"
    near = " ".join(near)
    docs = documents([
        (3, shared, "a"), (7, near, "a"), (7, own, "b"), (7, other, "b"), (7, other, "b"),  # one copy, two texts of their own
        (8, own, "a"), (2, prose(rng, 60), "a"), (2, prose(rng, 60), "a"),
    ])
    kept = corpus_pipeline.jaccard_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert [i for i, _ in got] == [2, 2, 3, 7, 7]
    assert (3, shared) in got and (7, near) not in got and {t for i, t in got if i == 7} == {own, other}


def test_pipeline_stages_on_an_empty_table(spark, documents, tmp_path):
    labels = [(1, 0, 1), (2, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents([(1, "x y", "a")]).filter("doc_id > 1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty(), name
