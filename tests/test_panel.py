"""Ordered helpers, blocks, joins, history, sets against plain Python or plain windows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from paneltide import schema
from paneltide.operators import blocks, history, joins, sets
from paneltide.operators.ordered import Measure, global_position, in_slices, rank_in_group, running
from paneltide.plans import catalog


def skewed(spark, n=3000):
    """A third of the rows share one key, and most of those share one leading order value."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        at = 5 if key == "hot" and rng.random() < 0.9 else rng.randrange(100)
        rows.append((key if rng.random() > 0.01 else None, at, i, float(rng.randrange(1000))))
    return spark.createDataFrame(rows, "k string, at int, id int, v double").repartition(5)


def test_rank_equals_window_and_hot_key_is_cut(spark):
    df = skewed(spark)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
    for rows_a_slice in (1_000_000, 100):
        got = rank_in_group(df, ["k"], ["at", "id"], "rn", rows_a_slice=rows_a_slice)
        assert got.join(want, "id").where("rn <> w").count() == 0 and got.count() == df.count()
    sizes = {(r.k, r.s): r["count"] for r in in_slices(df, ["k"], ["at", "id"], "s", 100).groupBy("k", "s").count().collect()}
    # A thousand rows of the hot key in slices of about a hundred; other keys stay whole.
    assert 5 <= sum(k == "hot" for k, _ in sizes) <= 20 and max(n for (k, _), n in sizes.items() if k == "hot") < 300
    assert {s for k, s in sizes if k != "hot"} == {0}


def test_all_times_tied(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", 7, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    got = rank_in_group(df, ["k"], ["at", "id"], "rn", rows_a_slice=40)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")))
    assert got.columns == ["k", "at", "id", "rn"]
    assert got.join(want, "id").where("rn = w").count() == 900


def test_keys_without_inputs_stay(spark):
    keys = spark.createDataFrame([("a", "data", 0, 1, 2), ("b", "data", 0, 1, 2)], "full_name string, attribute_name string, clone_num int, tr_start int, tr_end int")
    deps = spark.createDataFrame([("a", "data", "c", "data")], "full_name string, attribute_name string, input_full_name string, input_attribute_name string")
    stored = keys.limit(0).withColumn("value", F.lit(1.0))
    got = {r.full_name: r.inputs for r in joins.gather_inputs(keys, deps, stored).collect()}
    assert got == {"a": {"c.data": None}, "b": {}}


def test_numeric_names_stay_text(spark, tmp_path):
    df = spark.createDataFrame([block("a", 0, 0, 1, 1.0)], BLOCK).withColumn("attribute_name", F.lit("001"))
    blocks.write_blocks(df, str(tmp_path / "b"))
    assert [r.attribute_name for r in blocks.read_blocks(spark, str(tmp_path / "b")).collect()] == ["001"]


def test_row_shapes(spark):
    df = spark.createDataFrame([block("a", 0, 0, 1, 1.0)], BLOCK)
    plain = lambda t: T.StructType.fromJson(json.loads(t.json().replace('"nullable":false', '"nullable":true')))
    value = T.DoubleType()
    assert plain(history.iterator_rows(df).schema) == schema.iterator_schema(value)
    assert plain(history.clone_rows(df).schema) == schema.clones_schema(value)
    assert plain(history.time_series_rows(df).schema) == schema.time_series_schema(value)
    assert schema.block_schema().fieldNames() == df.columns


def test_running_equals_window(spark):
    df = skewed(spark)
    measures = [Measure("n", "count", F.col("v")), Measure("s", "sum", F.col("v")), Measure("lo", "min", F.col("v")),
                Measure("hi", "max", F.struct("v", "id"))]
    got = running(df, ["k"], [F.col("at"), F.col("id")], measures, F.floor(F.col("at") / 7))
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("id", F.count("v").over(w).alias("n1"), F.sum("v").over(w).alias("s1"), F.min("v").over(w).alias("lo1"),
                     F.max(F.struct("v", "id")).over(w).alias("hi1"))
    both = got.join(want, "id")
    assert both.count() == df.count()
    assert both.where("NOT (n <=> n1 AND s <=> s1 AND lo <=> lo1 AND hi <=> hi1)").count() == 0


def test_global_position(spark):
    df = skewed(spark)
    rows = global_position(df, [F.col("k"), F.col("at"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    keys = [(r.k is not None, r.k or "", r.at, r.id) for r in rows]
    assert keys == sorted(keys)


T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


BLOCK = ("full_name string, attribute_name string, clone_num int, tr_start timestamp, tr_end timestamp, chunk_num int, "
         "version timestamp, value double, lock_value boolean")


def block(name, clone, start, version, value, chunk=0, lock=False, length=1):
    return (name, "data", clone, day(start), day(start + length), chunk, day(version), value, lock)


def test_latest_and_ties(spark):
    df = spark.createDataFrame([block("a", 0, 0, 1, 1.0), block("a", 0, 0, 2, 2.0), block("a", 0, 0, 2, 3.0), block("b", 0, 0, 1, None)], BLOCK)
    out = {r.full_name: r.value for r in blocks.latest_version(df, tie_break=F.col("value")).collect()}
    assert out == {"a": 2.0, "b": None}
    plan = blocks.latest_version(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # below and above the shuffle
    pruned = blocks.latest_version(df.unionAll(df)).select("full_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "value" not in pruned.split("LogicalRDD")[0].split("Window")[-1]


def test_compact_keeps_all_chunks_of_the_winner(spark):
    df = spark.createDataFrame(
        [block("a", 0, 0, 1, 1.0), block("a", 0, 0, 2, 2.0, 0), block("a", 0, 0, 2, 3.0, 1), block("a", 5, 0, 2, 9.0), block("a", 0, 50, 2, 9.0)], BLOCK)
    out = blocks.compact(df, F.lit("2025-01-01").cast("timestamp"), [0, 1], (F.lit(day(0)), F.lit(day(10)))).collect()
    assert sorted((r.chunk_num, r.value) for r in out) == [(0, 2.0), (1, 3.0)]
    assert {r.version for r in out} == {dt.datetime(2025, 1, 1)}


def test_store_round_trip_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([block(n, c, s, 1, float(s)) for n in "ab" for c in range(40) for s in range(5)], BLOCK)
    blocks.write_blocks(df, path)
    got = blocks.read_blocks(spark, path, clone_nums=list(range(35)), time_range=(F.lit(day(1)), F.lit(day(4))), lock_value=False)
    assert got.count() == 2 * 35 * 3
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = got.where("version IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1]
    assert "In(clone_num" in pushed and "GreaterThanOrEqual(tr_start" in pushed and "EqualTo(lock_value" in pushed
    assert blocks.drop_version(df, F.lit(day(1))).count() == 0 == blocks.drop_version(df).count()


def test_chunks(spark):
    df = spark.createDataFrame([("a", i, f"p{i}") for i in range(10)] + [("b", 0, "x")], "k string, n int, t string")
    parts = blocks.assemble_chunks(df.repartition(4), ["k"], "t", "n", segment_size=4).orderBy("k", "segment").collect()
    assert [p for r in parts if r.k == "a" for p in r.pieces] == [f"p{i}" for i in range(10)] and len(parts) == 4
    numbered = blocks.split_chunks(df, ["k"], ["n"], 3, "t").where("k = 'a'").orderBy("n").collect()
    assert [r.chunk_num for r in numbered] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    with pytest.raises(Exception, match="exceeds max batch size 1"):
        blocks.split_chunks(df, ["k"], ["n"], 3, "t", max_bytes=1).collect()


def test_history_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.5 else "b", rng.randrange(60), rng.randrange(1, 40), float(rng.randrange(100))) for _ in range(300)]
    spans = spark.createDataFrame([(i, k, day(s), day(s + n), v) for i, (k, s, n, v) in enumerate(rows)],
                                  "i int, k string, tr_start timestamp, tr_end timestamp, value double")
    for width in (None, 86_400 * 7):
        apart = history.history_asof(spans.select("i", "k", "tr_start"), spans, keys=["k"], slice_seconds=width).collect()
        alone = history.history_asof(spans, keys=["k"], slice_seconds=width).collect()
        assert len(apart) == len(alone) == len(rows)
        for r in [*apart, *alone]:
            k, s, _, _ = rows[r.i]
            past = [(s2 + n2, s2, v2) for k2, s2, n2, v2 in rows if k2 == k and s2 + n2 <= s]
            assert r.n_history == len(past)
            assert r.sum_history == (sum(p[2] for p in past) if past else None)
            assert r.last_value == (max(past)[2] if past else None)


def test_prior_clones_brute_force(spark):
    rng = random.Random(6)
    cells = [(c, d) for c in range(12) for d in range(4)]
    held = {cd: float(rng.randrange(50)) for cd in cells if rng.random() < 0.7}
    b = spark.createDataFrame([block("a", c, d, 1, v) for (c, d), v in held.items()], BLOCK)
    grid = spark.createDataFrame([block("a", c, d, 1, None) for c, d in cells], BLOCK).select("full_name", "attribute_name", "clone_num", "tr_start", "tr_end")
    for r in history.prior_clones(grid, b, clones_per_slice=5).collect():
        d = (r.tr_start - T0).days
        past = {c: v for (c, d2), v in held.items() if d2 == d and c < r.clone_num}
        assert (r.n_prior, r.sum_prior, r.last_prior) == (
            len(past), sum(past.values()) if past else None, past[max(past)] if past else None)


def test_time_series_modes(spark):
    rows = [block("a", 0, d, 1, float(d)) for d in range(6)]
    df = spark.createDataFrame(rows, BLOCK)
    days = lambda out: sorted((r.tr_start - T0).days for r in out.collect())
    ranges = df.select("tr_start", "tr_end")
    assert days(history.time_series(df, ranges)) == [1, 2, 3, 4]
    assert days(history.time_series(df, ranges, as_of=F.lit(day(3)))) == [1, 2]
    assert days(history.time_series(df, ranges, mode="valid", valid_range=(F.lit(day(2)), F.lit(day(4))))) == [2, 3]
    assert days(history.time_series(df, ranges, drop_sentinels=False)) == list(range(6))
    with pytest.raises(ValueError):
        history.time_series(df, ranges, mode="other")


def test_merge_keyed_brute_force(spark):
    rng = random.Random(8)
    tables = [[(rng.randrange(6), i, float(rng.randrange(99))) for i in range(n)] for n in (30, 20, 0, 45)]
    frames = [spark.createDataFrame(t, "key int, id int, value double") for t in tables]
    got = {(r["key"], r.occurrence): (r.value_0, r.value_1, r.value_2, r.value_3) for r in joins.merge_keyed(frames, ["key"], ["id"]).collect()}
    want = {}
    for at, t in enumerate(tables):
        seen = {}
        for key, _, value in sorted(t, key=lambda x: x[1]):
            seen[key] = seen.get(key, 0) + 1
            want.setdefault((key, seen[key]), [None] * 4)[at] = value
    assert got == {k: tuple(v) for k, v in want.items()}


def test_zip_strict(spark):
    a = spark.createDataFrame([(3,), (1,), (2,)], "x int")
    b = spark.createDataFrame([("c",), ("a",), ("b",)], "y string")
    out = joins.zip_strict([a, b], [["x"], ["y"]]).orderBy("position").collect()
    assert [(r.item_0.x, r.item_1.y) for r in out] == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="different lengths"):
        joins.zip_strict([a, b.limit(2)], [["x"], ["y"]]).collect()


def test_overlay_prefers_fresh_nulls(spark):
    fresh = spark.createDataFrame([(1, None), (2, 2.0)], "k int, value double")
    old = spark.createDataFrame([(1, 9.0), (3, 3.0)], "k int, value double")
    assert {r.k: r.value for r in joins.overlay(fresh, old, ["k"]).collect()} == {1: None, 2: 2.0, 3: 3.0}
    assert {r.k for r in joins.overlay(fresh, old, ["k"], full=False).collect()} == {1, 2}


def test_locks(spark):
    computed = spark.createDataFrame([block("a", c, 0, 1, float(c)) for c in range(3)], BLOCK)
    locks = computed.where("clone_num < 2").select("clone_num", "tr_start", "tr_end")
    stored = spark.createDataFrame([block("a", 0, 0, 0, 77.0, lock=True), block("a", 2, 0, 0, 88.0, lock=True)], BLOCK)
    out = {r.clone_num: (r.value, r.lock_value) for r in joins.apply_locks(computed, locks, stored, F.lit(day(9))).collect()}
    assert out == {0: (77.0, True), 1: (None, True), 2: (2.0, False)}
    assert [r.clone_num for r in joins.unlocked(computed, locks).collect()] == [2]


def test_within_many_ranges(spark):
    rng = random.Random(9)
    rows = [(i, "ab"[i % 2], rng.randrange(50), rng.randrange(1, 5)) for i in range(80)]
    spans = [(i, "ab"[i % 2], rng.randrange(50), rng.randrange(1, 30)) for i in range(30)]
    left = spark.createDataFrame([(i, k, day(s), day(s + n)) for i, k, s, n in rows], "i int, k string, tr_start timestamp, tr_end timestamp")
    right = spark.createDataFrame([(j, k, day(s), day(s + n)) for j, k, s, n in spans], "j int, k string, lo timestamp, hi timestamp")
    open_ = spark.createDataFrame([(99, "a", "0001-01-01", "9999-12-31")], "j int, k string, lo string, hi string")
    right = right.unionByName(open_.withColumns({c: F.col(c).cast("timestamp") for c in ("lo", "hi")}))
    want = {(i, j) for i, k, s, n in rows for j, k2, s2, n2 in spans if k == k2 and s >= s2 and s + n <= s2 + n2}
    want |= {(i, 99) for i, k, _, _ in rows if k == "a"}
    for many in (False, True):
        out = [(r.i, r.j) for r in joins.within_range(left, right, ["k"], many=many).select("i", "j").collect()]
        assert len(out) == len(set(out)) and set(out) == want
    assert joins.within_range(left.limit(0), right, ["k"], many=True).count() == 0


def test_range_cells(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.choice([0, 1, 2, 7, 300, 10**6])) for a in [rng.randrange(-5000, 5000) for _ in range(200)]] + [(0, 0), (1, 1), (-1, 0), (5, 4)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "i int, a long, b long")
    out = df.select("i", joins.range_cells(F.col("a"), F.col("b"), 3, 40).alias("cells")).collect()
    for r in out:
        a, b = spans[r.i]
        covered = sorted((c.cell << (c.level - 3), (c.cell + 1 << (c.level - 3)) - 1) for c in r.cells)
        assert len(r.cells) <= 2 * max(1, (b - a + 1).bit_length())
        # The cells meet end to end from the first number to the last.
        assert covered == [] if b < a else covered[0][0] == a and covered[-1][1] == b
        assert all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:]))


def test_merge_with_groups(spark):
    keys = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "key int, group_idx int")
    keys = keys.unionAll(spark.createDataFrame([(2, 2)], keys.schema))
    groups = spark.createDataFrame([(0, ["x", "y"]), (1, ["y"]), (2, [])], "group_idx int, ids array<string>")
    data = spark.createDataFrame([(1, "x", 1.0), (1, "z", 5.0)], "key int, id string, value double")
    out = {(r["key"], r.group_idx): r["values"] for r in joins.merge_with_groups(keys, data, groups, ["key"]).collect()}
    assert out == {(1, 0): {"x": 1.0, "y": None}, (1, 1): {"y": None}, (2, 0): {"x": None, "y": None}, (2, 2): {}}


def test_diff_elements(spark):
    kind = "a int, b struct<c:int>, d int, e int"
    new = spark.createDataFrame([(1, (2,), None, None), (None, None, 3, None), (None, None, 3, None)], kind)
    old = spark.createDataFrame([(1, (2,), None, None), (None, None, None, 4)], kind)
    pick = lambda df: sorted((r.d or 0, r.e or 0) for r in df.collect())
    assert pick(sets.diff_elements(new, old, "new")) == [(3, 0)]
    assert pick(sets.diff_elements(new, old, "old")) == [(0, 4)]
    assert pick(sets.diff_elements(new, old)) == [(0, 4), (3, 0)]
    assert sets.diff_elements(None, old).count() == 2 and sets.diff_elements(new, None, "new").count() == 2


def test_limits_join_before_keys_multiply(spark, tmp_path):
    month = lambda m: dt.datetime(2024, m, 1)
    orders = [(1, 1, dt.datetime(2024, 1, 5), "1-URGENT"), (2, 1, dt.datetime(2024, 3, 9), "3-MEDIUM"),
              (3, 2, dt.datetime(2024, 2, 1), "2-HIGH"), (4, 2, dt.datetime(2024, 4, 30), "2-HIGH"), (5, None, month(5), "4")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").withColumn(
        "o_totalprice", F.lit(1.0)).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    out = catalog.queries()["valid_cells"](spark, str(tmp_path))
    want = [("c1", c, m) for c in (1, 3) for m in (1, 2)] + [("c2", 2, m) for m in (2, 3)] * 2
    rows = [(r.full_name, r.clone_num, r.tr_start, r.tr_end, r.attribute_name) for r in out.collect()]
    assert sorted(rows) == sorted((n, c, month(m), month(m + 1), "data") for n, c, m in want)
    # No join stands above the rows that multiply, so none can broadcast them.
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert len(plan) == 2 and "Generate explode" in plan[0] and "Generate" not in plan[1] and "merge" in plan[1]
