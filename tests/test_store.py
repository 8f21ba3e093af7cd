"""Blocks replaced in place: whole, all at once, or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneltide.sources import store

BLOCK = "full_name string, attribute_name string, clone_num int, tr_start timestamp, tr_end timestamp, chunk_num int, version timestamp, value double"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def rows(*blocks):
    return [("n", name, clone, day(start), day(start + 1), chunk, day(version), value) for name, clone, start, chunk, version, value in blocks]


FIRST = rows(("001", 0, 0, 0, 1, 1.0), ("001", 0, 0, 0, 2, 2.0), ("a/b=[*] é", 0, 0, 0, 1, 3.0), (None, 0, 0, 0, 1, 4.0), ("z", 0, 0, 0, 9, 5.0), ("z", 0, 1, 1, 9, 6.0))


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "store")
    store.append(spark.createDataFrame(FIRST, BLOCK), where)
    return where


def held(spark, path):
    return sorted(((r.attribute_name, r.version, r.value) for r in store.read_store(spark, path).collect()), key=repr)


def want(*found):
    return sorted(((n, day(v), x) for n, v, x in found), key=repr)


def at(n):
    return F.lit(day(n)).cast("timestamp")


def test_names_columns_and_appends(spark, path):
    names = [f.strip().split(" ")[0] for f in BLOCK.split(",")]
    assert store.read_store(spark, path).columns == names
    odd = "a/b=[*] é"
    assert held(spark, path) == want(("001", 1, 1.0), ("001", 2, 2.0), (odd, 1, 3.0), (None, 1, 4.0), ("z", 9, 5.0), ("z", 9, 6.0))
    store.append(spark.createDataFrame(rows(("001", 7, 0, 0, 3, 7.0)), BLOCK).select(*reversed(names)), path)
    assert len(held(spark, path)) == 7 and store.read_store(spark, path).where("clone_num = 7").count() == 1
    with pytest.raises(ValueError, match="the store holds"):
        store.append(spark.range(1), path)
    with pytest.raises(ValueError, match="nothing was written"):
        store.read_store(spark, path + "-none")


def test_only_touched_partitions_are_replaced(spark, path):
    before = store.current_state(spark, path)
    reader = store.read_store(spark, path)
    store.drop_version(spark, path, at(1))
    after = store.current_state(spark, path)
    assert held(spark, path) == want(("001", 2, 2.0), ("z", 9, 5.0), ("z", 9, 6.0))
    assert after.number == before.number + 1 and after.parts["attribute_name=z"] == before.parts["attribute_name=z"]
    assert after.parts["attribute_name=001"] != before.parts["attribute_name=001"] and len(after.parts) == 2
    assert reader.count() == 6  # who read before goes on reading what was there
    store.drop_version(spark, path, at(77))
    assert store.current_state(spark, path).number == after.number
    assert store.remove_unused(spark, path, 3600) == 0 and store.remove_unused(spark, path, -1) == 3
    assert len(held(spark, path)) == 3
    store.drop_version(spark, path)
    assert held(spark, path) == [] and store.read_store(spark, path).schema.simpleString() == reader.schema.simpleString()


def test_compact_in_place(spark, path):
    before = store.current_state(spark, path)
    store.append(spark.createDataFrame(rows(("001", 5, 0, 0, 8, 8.0), ("q", 0, 90, 0, 9, 9.0)), BLOCK), path)
    store.compact(spark, path, at(9), [0], (at(0), at(50)))
    assert held(spark, path) == want(("001", 9, 2.0), ("a/b=[*] é", 9, 3.0), (None, 9, 4.0), ("z", 9, 5.0), ("z", 9, 6.0))
    state = store.current_state(spark, path)
    assert state.parts["attribute_name=z"] == before.parts["attribute_name=z"]
    store.compact(spark, path, at(9), [0], (at(0), at(50)))
    assert store.current_state(spark, path) == state


def test_a_writer_that_dies_changes_nothing(spark, path, monkeypatch):
    before = held(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.drop_version(spark, path, at(1))
        with pytest.raises(KeyboardInterrupt):
            store.append(spark.createDataFrame(FIRST, BLOCK), path)
    assert held(spark, path) == before
    broken = spark.createDataFrame(FIRST, BLOCK).withColumn("value", F.when(F.col("value") > 5, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        store.append(broken, path)
    assert held(spark, path) == before
    store.drop_version(spark, path, at(1))
    assert len(held(spark, path)) == 3


def test_of_two_writers_one_has_to_try_again(spark, path, monkeypatch):
    real = store._add

    def overtaken(df, where):
        out = real(df, where)
        monkeypatch.setattr(store, "_add", real)
        store.append(spark.createDataFrame(rows(("late", 0, 0, 0, 1, 0.5)), BLOCK), where)
        return out

    monkeypatch.setattr(store, "_add", overtaken)
    with pytest.raises(store.StoreChanged):
        store.drop_version(spark, path, at(1))
    assert len(held(spark, path)) == 7
    store.drop_version(spark, path, at(1))
    assert held(spark, path) == want(("001", 2, 2.0), ("z", 9, 5.0), ("z", 9, 6.0))
