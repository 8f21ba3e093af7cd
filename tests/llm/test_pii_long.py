"""Personal data in long texts, the sweep over spans, and the estimate of labelers."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from paneltide.llm import pii


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 20000])
def test_running_fold(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: (x * 7919 % 101).cast("int")).alias("a")).select(F.slice("a", 1, n).alias("a"))
    a, sums, most = df.select(
        "a", pii.running_fold(F.col("a"), F.lit(0), lambda x, y: x + y), pii.running_fold(F.col("a"), F.lit(0), lambda x, y: F.greatest(x, y))
    ).first()
    total, top, want, high = 0, 0, [], []
    for x in a:
        total, top = total + x, max(top, x)
        want.append(total)
        high.append(top)
    assert sums == want and most == high


def test_spans_apart_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        make = lambda n: sorted({(s, s + rng.randint(1, 6)) for s in (rng.randrange(60) for _ in range(n))})
        rows.append((i, make(rng.randrange(8)), make(rng.randrange(12))))
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, a {span}, b {span}")
    for r in df.select("i", "a", "b", pii._apart(F.col("a"), F.col("b")).alias("c")).collect():
        want = [tuple(s) for s in r.a if not any(s.start < b.end and b.start < s.end for b in r.b)]
        assert sorted(map(tuple, r.c)) == want


def test_a_hundred_thousand_addresses(spark):
    one = "write to user.name@host.example.com or 10.20.30.40, call +49 30 1234567; or a (at) b.org or 555-123-4567 now. "
    took = {}
    for n in (5_000, 50_000):
        df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(one), n).alias("text"))
        start = time.time()
        r = pii.find_personal_data(df).first()
        took[n] = time.time() - start
        assert (r.n_email, r.n_ip, r.n_phone) == (n, n, n)
        assert r.spans.startswith(f"email:{one.index('user')}:")
    print(took)
    # Ten times the text may not take more than about ten times the time.
    assert took[50_000] < 60 and took[50_000] < 25 * max(took[5_000], 1.0)


def test_estimate_finds_reliabilities():
    """Votes drawn with known reliabilities: the estimate finds which spans are true."""
    rng = random.Random(6)
    right = (0.95, 0.9, 0.8, 0.75, 0.6)
    counts, true_of = {}, {}
    for _ in range(20_000):
        truth = rng.random() < 0.4
        key = (0, *[(1 if truth else -1) * (1 if rng.random() < p else -1) for p in right])
        counts[key] = counts.get(key, 0) + 1
        true_of.setdefault(key, []).append(truth)
    got = pii.estimate(list(counts.items()))
    for key, n in counts.items():
        if n > 200:
            odds = math.log(0.4 / 0.6) + sum((1 if v > 0 else -1) * math.log(p / (1 - p)) for v, p in zip(key[1:], right))
            assert got[key] == pytest.approx(1 / (1 + math.exp(-odds)), abs=0.1)
    wrong = sum(n * (sum(true_of[k]) / n if got[k] < 0.5 else 1 - sum(true_of[k]) / n) for k, n in counts.items())
    assert wrong / 20_000 < 0.06


def test_classifier_sees_more_than_votes():
    votes = (0, 0, 0, 0, 0)
    seen = [((0, *votes, 1, 0, 0, 1, 1), 50.0), ((3, *votes, 0, 1, 0, 0, 0), 50.0), ((0, 1, 1, 1, 0, 1, 1, 0, 0, 1, 1), 500.0), ((3, -1, -1, -1, 0, -1, 0, 1, 0, 0, 0), 500.0)]
    weights = pii.fit_classifier(seen, pii.estimate([((0, *votes), 50.0), ((3, *votes), 50.0), ((0, 1, 1, 1, 0, 1), 500.0), ((3, -1, -1, -1, 0, -1), 500.0)]))
    score = lambda key: sum(a * b for a, b in zip(weights, pii._features(key)))
    assert score(seen[0][0]) > score(seen[1][0])
