"""Mixing and sharding row by row against plain Python."""

import collections
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from paneltide.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TARGETS = {"source": {"a": 3.0, "b": 1.0}, "lang": {"en": 2.0, "de": 1.0, "*": 1.0}, "topic": {"note": 1.0, "table": 1.0, "article": 2.0}}


def spark_hash(*values):
    """Spark's xxhash64: one seeded hash after the other; NULL changes nothing."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def topic_of(text):
    t = text or ""
    n = max(len(t), 1)
    if sum(c in "#*$%&<>" for c in t) / n > 0.03:
        return "symbols"
    if " | " in t:
        return "table"
    if sum(c in "0123456789" for c in t) / n > 0.03:
        return "figures"
    return "note" if n < 1000 else "article" if n < 8000 else "book"


def fitted(cells, targets, budget):
    """Plain proportional fitting, many rounds, every cell at most its tokens."""
    weights = {k: v * budget / sum(cells.values()) for k, v in cells.items()}
    goals = []
    for d, target in enumerate(targets):
        present = {k[d] for k, v in cells.items() if v > 0}
        natural = sum(v for k, v in cells.items() if k[d] == "*") / sum(cells.values()) if "*" not in target else 0.0
        known = {c: target[c] for c in present if c in target}
        goals.append({c: budget * (1 - natural) * x / sum(known.values()) for c, x in known.items()} | ({"*": budget * natural} if natural else {}))
    for _ in range(3000):
        for d, goal in enumerate(goals):
            for c in {k[d] for k in cells}:
                own = [k for k in cells if k[d] == c]
                have = sum(weights[k] for k in own)
                for k in own:
                    if have > 0:
                        weights[k] = min(cells[k], weights[k] * goal.get(c, 0.0) / have)
    return weights


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for i in range(300):
        text = rng.choice([None, "", "one two", "a | b | c", "### $$$ %%%", "12 34 5678 9", "word " * rng.randrange(1, 600), "long words here " * 600])
        out.append((rng.choice([i, i, i, 7, None]), text, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", "c", None])))
    return out


def test_every_row_of_the_mix(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, p_ int, p_cell string, cell_ int")
    cells = collections.defaultdict(float)
    seen = []
    for i, t, lang, source in rows:
        topic = topic_of(t)
        key = tuple(v if v in target and v != "*" else "*" for v, target in zip((source, lang, topic), TARGETS.values()))
        seen.append((i, source, lang, topic, len(WORD.findall(t or "")), key))
        cells[key] += seen[-1][4]
    weights = fitted(cells, list(TARGETS.values()), 0.3 * sum(cells.values()))
    want = collections.Counter()
    for i, source, lang, topic, n, key in seen:
        p = weights[key] / cells[key] if cells[key] else 0.0
        want[i, source, lang, topic, n, round(p, 5), (spark_hash(i, "mix") >> 11) / 2**53 < p] += 1
    got = collections.Counter((*tuple(r)[:5], round(r.probability, 5), r.kept) for r in mixing.mix_weights(df, TARGETS, 0.3).collect())
    assert got == want
    kept = mixing.mix_documents(df, TARGETS, 0.3)
    assert kept.columns == df.columns and kept.count() == sum(n for k, n in want.items() if k[-1])


def test_every_row_of_the_shards(spark, rows):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")


    def shard(i, n):
        return min((-math.log((spark_shard(i, s) + 0.5) / 2**53), s) for s in range(n))[1]

    def spark_shard(i, s):
        seed = spark_hash(i)
        return xxhash.xxh64_intdigest(s.to_bytes(4, "little", signed=True), seed=seed) >> 11

    got = sharding.assign_shards(df).collect()
    assert all((r.shard, r.grown_shard) == (shard(r.doc_id, 16), shard(r.doc_id, 17)) for r in got) and len(got) == len(rows)


def test_one_id_spreads_over_blocks(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = sharding.assign_shards(df)
    assert sorted(r.slot for r in out.collect()) == list(range(4000))
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit("block")), F.lit(sharding.BLOCKS))
    assert df.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] < 20
