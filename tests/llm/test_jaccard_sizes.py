"""The planner's size guesses in the loops of the Jaccard join, whose digits fill the driver when they multiply."""

import corpus_pipeline
from paneltide.llm import jaccard_join


def beyond_all_sizes(df):
    """Is the size that the planner guesses too large for any unit, so that Spark shows it as a power of ten?"""
    return "E+" in df._jdf.queryExecution().optimizedPlan().stats().simpleString()


def test_a_long_chain_keeps_its_size_guess(spark):
    n = 5_000
    labels = jaccard_join.connect(spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"))
    assert not beyond_all_sizes(labels)
    assert labels.count() == n and labels.where("label <> 0").isEmpty()


def test_rounds_of_pivots_keep_their_size_guess(spark, monkeypatch):
    connect, by_pivots, guesses = jaccard_join.connect, jaccard_join.JaccardJoin._by_pivots, []
    monkeypatch.setattr(jaccard_join, "connect", lambda links: guesses.append(beyond_all_sizes(links)) or connect(links))
    monkeypatch.setattr(
        jaccard_join.JaccardJoin, "_by_pivots", lambda join, members, n: guesses.append(beyond_all_sizes(members)) or by_pivots(join, members, n)
    )
    # A passage that all texts share, and pairs of near copies which the first pivots do not connect.
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} " + " ".join(f"w{i // 2}x{k}" for k in range(30)) + f" end{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df, few=8).collect()}
    assert got == {i: i - i % 2 for i in range(300)}
    assert len(guesses) >= 4 and not any(guesses)


def test_the_pipelines_near_duplicates_keep_their_size_guess(spark, monkeypatch):
    connect, guesses = jaccard_join.connect, []
    monkeypatch.setattr(jaccard_join, "connect", lambda links: guesses.append(beyond_all_sizes(links)) or connect(links))
    chain = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([f"n{k}" for k in range(i)] + chain[i:]), "en", "src0", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near(spark, docs, "")
    assert [r["doc_id"] for r in kept.collect()] == [0] and guesses and not any(guesses)
