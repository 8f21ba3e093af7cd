"""The depth-first order of first visits against a plain walk."""

import random

import pytest

from paneltide.operators import graph
from paneltide.session import written

EDGE = "parent string, child string, ord int"


def walk(edges, root, directed=True):
    """``[(node, depth)]`` in the order of first visits."""
    below = {}
    for parent, child, place in edges:
        if parent is None or child is None:
            continue
        for a, b in [(parent, child)] + ([] if directed else [(child, parent)]):
            below.setdefault(a, {})
            below[a][b] = min(place, below[a].get(b, place))
    seen, order, stack = set(), [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append((node, depth))
        stack += [(c, depth + 1) for c, _ in sorted(below.get(node, {}).items(), key=lambda kv: (kv[1], kv[0]), reverse=True)]
    return order


def visited(spark, edges, root, directed=True):
    rows = graph.first_visits(spark.createDataFrame(edges, EDGE), root, directed).orderBy("place").collect()
    return [(r.node, r.depth) for r in rows]


def test_a_long_way_round_comes_first(spark):
    edges = [("r", "a", 0), ("a", "b", 1), ("b", "c", 2), ("r", "c", 3), ("c", "d", 4), ("r", "d", 5)]
    assert visited(spark, edges, "r") == [("r", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    out = {r.node: (r.level, r.rank) for r in graph.hierarchy_levels(spark.createDataFrame(edges, EDGE), "r").collect()}
    assert out == {"r": (0, 0), "a": (1, 0), "b": (2, 0), "c": (3, 0), "d": (4, 0)}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs_without_circles(spark, seed):
    rng = random.Random(seed)
    edges = [(str(a), str(b), rng.randrange(9)) for a, b in
             (sorted(rng.sample(range(26), 2)) for _ in range(60))]
    assert visited(spark, edges, "0") == walk(edges, "0")


@pytest.mark.parametrize("directed", [True, False])
def test_random_graphs_with_circles(spark, directed):
    rng = random.Random(11)
    edges = [(str(rng.randrange(10)), str(rng.randrange(10)), rng.randrange(5)) for _ in range(16)]
    assert visited(spark, edges, "0", directed) == walk(edges, "0", directed)


def test_odd_rows(spark):
    edges = [("r", "r", 0), (None, "a", 0), ("r", None, 0), ("r", "a", 2), ("r", "a", 7), ("r", "b", 1), ("b", "r", 0),
             ("x", "y", 0), ("y", "x", 0), ("y", "a", 0), ("z", "b", -1)]
    assert visited(spark, edges, "r") == [("r", 0), ("b", 1), ("a", 1)]
    assert visited(spark, [], "r") == [("r", 0)] == visited(spark, [("a", "b", 0)], "r")


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or written(df))
    n = 100_000
    chain = spark.range(1, n).selectExpr("cast(id - 1 as string) AS parent", "cast(id as string) AS child", "0 AS ord")
    out = graph.first_visits(chain, "0")
    wrong = out.where("place <> cast(node as bigint) OR depth <> cast(node as int)")
    assert out.count() == n and wrong.isEmpty() and len(rounds) <= 2 * 17 + 9


def test_links_to_shared_leaves_are_not_written(spark, monkeypatch):
    rng = random.Random(5)
    edges = [("r", f"g{g}", g) for g in range(20)] + [(f"g{n % 20}", f"n{n}", n) for n in range(400)]
    edges += [(f"n{n}", f"p{rng.randrange(200)}", rng.randrange(50)) for n in range(300) for _ in range(30)]
    # Beside their own children, groups hold shared leaves too, some twice; one leaf hangs below the root.
    edges += [(f"g{rng.randrange(20)}", f"p{rng.randrange(260)}", rng.randrange(400)) for _ in range(300)] + [("r", "p259", 7)]
    rows = []

    def counted(df):
        out = written(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    assert visited(spark, edges, "r") == walk(edges, "r")
    assert sum(rows) < len(edges) / 2


def test_the_smallest_known_place_of_a_repeat_counts(spark):
    edges = [("r", "a", None), ("r", "a", 5), ("r", "b", 1), ("r", "c", None), ("a", "d", 2), ("b", "d", 3)]
    assert visited(spark, edges, "r") == [("r", 0), ("c", 1), ("b", 1), ("d", 2), ("a", 1)]
