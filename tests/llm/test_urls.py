"""URL filters against a rule-by-rule search."""

import random

import pytest

from poolscope.llm import urls

PAGES = "page_id long, url string, host string, range int, slot int"


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def brute(url, rules, default="allow"):
    host, path = parsed(url)
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def judge(spark, pages, rules, **more):
    made = spark.createDataFrame([(i, u, "x", 7, 9) for i, u in pages], PAGES)
    df = urls.judged(made, spark.createDataFrame(rules, "host string, path string, verdict string"), **more)
    assert df.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_rules(spark):
    rng = random.Random(5)
    hosts = ["net", "a.net", "b.a.net", "ab.net", "org", "x.org", "a", "b-a.net", "ä.net"]
    parts = ["/", "/e", "/en", "/en/", "/en/a", "/de/", "", "/En/", "/ä/"]
    for _ in range(2):
        rules = {(rng.choice(hosts), rng.choice(parts)): rng.choice(("block", "allow")) for _ in range(14)}
        rules = [(h, p, v) for (h, p), v in rules.items()]
        pages = []
        for i in range(300):
            host = rng.choice(["", "www.", "b.", "A."]) + rng.choice(hosts)
            url = "http://" + host + rng.choice(parts) + rng.choice(["", "n/1", "a", "/x"]) + rng.choice(["", "?q=/en/", "#t://"])
            pages.append((i, url))
        want = sorted(((i, *brute(u, rules)) for i, u in pages), key=repr)
        assert judge(spark, pages, rules) == want
        assert len({r[3] for r in want}) > 4


def test_odd_rows(spark):
    rules = [("net", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("", "", "block"), ("net", "x", "allow"), ("org", None, "block"), ("com", "/", None)]
    clean = [("net", "/", "block"), ("org", "", "block")]
    pages = [(1, None), (None, "http://a.net/1"), (2, ""), (3, "net/"), (4, "https://NET"), (4, "https://NET"), (5, "x://org?a"), (6, "http://com/"), (7, "://"), (8, "a://net/" + "y" * 50_000), (9, "http://Ä.net/\n#")]
    want = sorted(((i, *brute(u, clean)) for i, u in pages), key=repr)
    assert judge(spark, pages, rules) == want
    assert judge(spark, [], rules) == []
    assert {r[4] for r in judge(spark, pages, [], default="block")} == {"block"}


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_any_number_of_ranges(spark, ranges):
    rules = [("net", "/" + "a" * k, "block" if k % 2 else "allow") for k in range(12)] + [("b.net", "/aaa", "allow")]
    pages = [(i, f"h://{'b.' * (i % 3)}net/{'a' * (i % 15)}{'c' * (i % 2)}") for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        assert judge(spark, pages, rules) == sorted(((i, *brute(u, rules)) for i, u in pages), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
