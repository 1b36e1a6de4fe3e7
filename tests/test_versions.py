import re
from functools import cmp_to_key

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolscope.functions import versions as v


def rank(ch):
    if ch == "~":
        return -1
    if ch.isalpha():
        return ord(ch)
    return ord(ch) + 256


def compare_part(a, b):
    """Pairwise comparison as the packaging policy words it."""
    while a or b:
        x, y = re.match(r"\D*", a).group(), re.match(r"\D*", b).group()
        a, b = a[len(x):], b[len(y):]
        for i in range(max(len(x), len(y))):
            p = rank(x[i]) if i < len(x) else 0
            q = rank(y[i]) if i < len(y) else 0
            if p != q:
                return -1 if p < q else 1
        m, n = re.match(r"\d*", a).group(), re.match(r"\d*", b).group()
        a, b = a[len(m):], b[len(n):]
        if int(m or 0) != int(n or 0):
            return -1 if int(m or 0) < int(n or 0) else 1
    return 0


def compare(a, b):
    def split(text):
        epoch, _, rest = text.rpartition(":")
        up, dash, rev = rest.rpartition("-")
        return (int(epoch or 0), up, rev) if dash else (int(epoch or 0), rest, "")

    (e, u, r), (f, w, s) = split(a), split(b)
    if e != f:
        return -1 if e < f else 1
    return compare_part(u, w) or compare_part(r, s)


def keys(spark, texts, strict=False):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    return [r[0] for r in df.select(v.version_key(F.col("v"), strict)).collect()]


def test_key_text(spark):
    assert keys(spark, ["1:2.0-0.3", "2.0", None, "10a"]) == [
        "01!102h1001!100h1031", "00!102h1001!1", None, "00!1110L1!1",
    ]


ORDERED = [
    ("3~rc1", "3"), ("3", "3a"), ("3a", "3+b"), ("3.9", "3.10"), ("3-1", "3-2"), ("9:1", "10:1"),
    ("7.2~dev", "7.2~pre"), ("4.0", "4.0-0.5"), ("0", "a"), ("2.1-9", "2.1+git.2020-1"),
    ("1.20200101", "1.20210101"), ("5.1234567890123", "5.1234567890124"), ("9999", "2:1"),
]


@pytest.mark.parametrize("chunk", [ORDERED])
def test_pairs(spark, chunk):
    low = keys(spark, [a for a, _ in chunk])
    high = keys(spark, [b for _, b in chunk])
    assert all(a < b for a, b in zip(low, high))
    assert all(compare(a, b) < 0 for a, b in chunk)


def test_leading_zeros_tie_and_total_order(spark):
    df = spark.createDataFrame([("1.0", "1.00"), ("0:1.0", "1.0"), ("1.0", "1.0")], "a string, b string")
    got = df.select(
        v.compare_versions(F.col("a"), F.col("b")), v.compare_versions_total(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in got] == [(0, -1), (0, -1), (0, 0)]


version_text = st.from_regex(r"\A([0-9]{1,2}:)?[0-9A-Za-z.+~][0-9A-Za-z.+~-]{0,12}\Z")


@settings(max_examples=5, deadline=None)
@given(st.lists(version_text, min_size=20, max_size=60))
def test_key_order_is_pairwise_order(spark, texts):
    got = dict(zip(texts, keys(spark, texts)))
    ordered = sorted(texts, key=cmp_to_key(compare))
    for a, b in zip(ordered, ordered[1:]):
        c = compare(a, b)
        assert (got[a] < got[b]) if c < 0 else (got[a] == got[b]), (a, b)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abzAZ019.+-~", min_size=1), min_size=20, max_size=60))
def test_any_text_has_a_key(spark, texts):
    assert all(k is not None for k in keys(spark, texts))


def test_strict(spark):
    assert [k is None for k in keys(spark, ["1.0", "1_0", "x:1", "7" * 26, "7" * 27, "0" * 30 + "1"], True)] == [
        False, True, True, False, False, False,
    ]
    assert keys(spark, ["7" * 27])[0] > keys(spark, ["8" * 26])[0]


def test_runs_of_any_length(spark):
    lengths = (1, 3, 4, 9, 10, 27, 81, 100, 101, 113, 114, 160, 170, 171, 209, 220, 300, 4000)
    texts = [lead + "1" + "0" * (n - 1) for n in lengths for lead in ("", "a", "1.b", "2-0")] + ["9" * n for n in lengths]
    got = dict(zip(texts, keys(spark, texts, True)))
    ordered = sorted(texts, key=cmp_to_key(compare))
    assert None not in got.values()
    for a, b in zip(ordered, ordered[1:]):
        assert (got[a] < got[b]) == (compare(a, b) < 0), (a[:20], len(a), b[:20], len(b))
    epochs = keys(spark, ["9" * 205 + ":1", "1" * 220 + ":1"])
    assert epochs[0] < epochs[1]


def test_matches_and_full_version(spark):
    df = spark.createDataFrame(
        [("a", None, "b"), ("a", "<<", "b"), ("a", ">=", "b"), ("a", "==", "a"), ("a", "=", "a")],
        "a string, op string, b string",
    )
    got = df.select(v.version_matches(F.col("a"), F.col("op"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, True, False, None, True]
    df = spark.createDataFrame(
        [(None, "1", "0"), ("2", "1", "3"), ("", "1", None)], "e string, v string, r string"
    )
    got = df.select(v.full_version(F.col("e"), F.col("v"), F.col("r"))).collect()
    assert [r[0] for r in got] == ["1", "2:1-3", "1"]
