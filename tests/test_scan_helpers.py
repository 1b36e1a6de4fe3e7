import random
import statistics

from pyspark.sql import functions as F

from conftest import rows
from poolscope.functions.scan import first_ranks, grouped_median, running_max_before


def test_median_matches_plain_median(spark):
    rnd = random.Random(3)
    data = [("hot", rnd.choice([5, 70, 1 << 21, (1 << 21) + 3, rnd.randrange(1 << 33)])) for _ in range(301)]
    data += [(f"k{i % 9}", rnd.randrange(1 << 22)) for i in range(100)] + [("one", 7), ("two", 1), ("two", 4)]
    df = spark.createDataFrame(data, "k string, v bigint")
    got = dict(rows(grouped_median(df, "k", "v", "m")))
    for k in {k for k, _ in data}:
        assert got[k] == statistics.median([v for q, v in data if q == k])


def test_running_max_across_blocks(spark):
    rnd = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 7}", i, rnd.randrange(1000)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    got = {(k, t): m for k, t, v, m in running_max_before(df, ["k"], ["t"], F.floor(F.col("t") / 10), "v", "m").collect()}
    for k, t, _ in data:
        earlier = [v for q, u, v in data if q == k and u < t]
        assert got[k, t] == (max(earlier) if earlier else None)


def test_first_ranks_per_key(spark):
    data = [("a", f"x{i:03}", 3) for i in range(100)] + [("b", "y", 5), ("b", "z", 5)]
    df = spark.createDataFrame(data, "k string, o string, n int")
    got = rows(first_ranks(df, ["k"], ["o"], "n", "r", salts=7), "k", "o", "r")
    assert got == [("a", "x000", 1), ("a", "x001", 2), ("a", "x002", 3), ("b", "y", 1), ("b", "z", 2)]
