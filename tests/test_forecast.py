"""Forecasts of nested values, and vectors of empty values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import features


def test_empty_values_keep_their_row(spark):
    df = spark.createDataFrame([(1, []), (2, [1.0]), (3, None), (4, [None, 2.0])], "k int, value array<double>")
    cats = features.build_categories(df, ["value"])
    flat = {r.k: r.features for r in features.flatten_features(df, ["k"], "value", cats).collect()}
    assert flat == {1: [], 2: [1.0], 3: [1.0], 4: [1.0, 2.0]}
    back = features.unflatten_features(df.join(features.flatten_features(df, ["k"], "value", cats), "k"), ["k"], "features", "value", cats)
    assert {r.k: r.value for r in back.collect()} == {1: [], 2: [1.0], 3: None, 4: [None, 2.0]}


def test_texts_unknown_and_named_like_fields(spark):
    df = spark.createDataFrame([(1, ("a", "x", {"k": "b"})), (2, ("b", "b", {}))], "k int, value struct<a:string,b:string,m:map<string,string>>")
    cats = features.build_categories(df, ["value"]).where("category <> 'x' OR category IS NULL")
    ids = {r.category: float(r.category_id) for r in cats.collect()}
    flat = {r.k: r.features for r in features.flatten_features(df, ["k"], "value", cats).collect()}
    assert flat == {
        1: [ids["a"], ids["a"], ids["b"], 0.0, ids["m"], ids["k"], ids["b"]], 2: [ids["a"], ids["b"], ids["b"], ids["b"], ids["m"]],
    }


def test_multi_ridge_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 3.0, (400, 4))
    x[:, 3] = 7.0  # never varies
    y = x[:, :3] @ rng.normal(size=(3, 2)) + rng.normal(size=(400, 2)) * 0.1 + 5
    rows = [(a.tolist(), b.tolist()) for a, b in zip(x, y)] + [([1.0], [2.0]), ([2.0], [4.0])]
    model = {(r.nx, r.ny): r for r in features.multi_ridge(spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(5)).collect()}
    assert set(model) == {(4, 2), (1, 1)}
    assert model[1, 1].weights[0][0] == pytest.approx(2.0)
    centred = x[:, :3] - x[:, :3].mean(0)
    want = np.linalg.lstsq(centred, y - y.mean(0), rcond=None)[0]
    got = np.array(model[4, 2].weights).T
    assert np.allclose(got[:3], want, atol=1e-6) and (got[3] == 0).all()
    assert np.allclose(model[4, 2].mean, [*x.mean(0), *y.mean(0)])


def test_forecast_nested(spark):
    """A value that follows its input exactly; short series and series of another shape repeat their last value."""
    own, other = [], []
    for k in range(12):
        for i in range(8):
            n = (k * 7 + i * i) % 11
            other.append((k, i, float(n)))
            own.append((k, i, ("up" if i % 2 else "down", [2.0 * other[-2][2] + 1 if i else 0.0, float(k)])))
    own += [(100, 0, ("up", [1.0, 2.0])), (101, 0, ("up", [1.0])), (101, 1, ("up", [3.0, 4.0, 5.0])), (102, 0, None), (102, 1, None)]
    kind = "k int, at int, value struct<text:string,nums:array<double>>"
    out = features.forecast_nested(spark.createDataFrame(own, kind), {"n": spark.createDataFrame(other, "k int, at int, value double")}, ["k"], "at", 1)
    got = {r.k: (r.prediction, r.method) for r in out.collect()}
    last = {k: v for k, i, v in other if i == 7}
    for k in range(12):
        assert got[k][1] == "regression" and got[k][0].nums == pytest.approx([2 * last[k] + 1, k], abs=1e-3)
    assert got[101][1] == "last" and got[101][0].nums == [3.0, 4.0, 5.0]
    assert got[102][0] is None
    empty = spark.createDataFrame([], kind)
    with pytest.raises(ValueError, match="no data"):
        features.forecast_nested(empty, {}, ["k"], "at", 1)
    assert out.schema["prediction"].dataType == empty.schema["value"].dataType
    assert out.where(F.col("k") == 100).first().method in ("regression", "last")
