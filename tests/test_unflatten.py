"""Vectors back to values with NULLs at every level."""

import datetime as dt

from pyspark.sql import types as T

from paneltide.operators import features

INNER = "struct<a:string,b:double>"
KIND = (
    f"id int, v struct<s:string,n:double,i:int,t:timestamp,d:date,l:array<string>,q:array<{INNER}>,r:array<array<int>>,"
    f"m:map<string,{INNER}>,u:{INNER},z:double>"
)
AT, DAY = dt.datetime(2024, 1, 1), dt.date(2024, 2, 3)


def round_trip(df):
    cats = features.build_categories(df, ["v"])
    flat = features.flatten_features(df, ["id"], "v", cats)
    back = features.unflatten_features(df.join(flat, "id"), ["id"], "features", "v", cats)
    return {r.id: r.value for r in back.collect()}, {r.id: r.v for r in df.collect()}


def test_nulls_at_every_level(spark):
    rows = [
        (1, ("x", 2.5, 3, AT, DAY, ["a", None], [("p", 1.0), None, ("q", None)], [[1], None, [2, 3]], {"k": ("x", 1.5), "j": None}, ("y", 2.0), 7.5)),
        (2, ("x", None, None, None, None, None, None, None, None, None, 7.5)),
        (3, (None, 1e300, None, AT, None, [], [], [[], [None, 4]], {}, (None, None), -1e300)),
        (4, None),
        (5, ("y", 1.0, 2, AT, DAY, None, [None], [None], {"k": ("y", None)}, None, 1e19)),
    ]
    got, want = round_trip(spark.createDataFrame(rows, KIND))
    assert got == want


def test_vector_out_of_range_gives_null(spark):
    kind = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("v", T.StructType([T.StructField(n, t) for n, t in (
            ("s", T.StringType()), ("i", T.IntegerType()), ("t", T.TimestampType()), ("d", T.DateType()), ("n", T.DoubleType()))])),
    ])
    big = [1e300, float("nan")]
    df = spark.createDataFrame([(k, [1.0, x, 1.0, x, 1.0, x, 1.0, x, 1.0, 5.0], ("a", 1, AT, DAY, 1.0)) for k, x in enumerate(big)], kind)
    cats = spark.createDataFrame([("a", 1), ("__UNK__", 0)], "category string, category_id long")
    rows = features.unflatten_features(df, ["id"], "features", "v", cats).collect()
    got = {r.id: tuple(r.value) for r in rows}
    assert got[1] == (None, None, None, None, 5.0)
    assert got[0][:2] == (None, None) and got[0][2].year == 9999 and got[0][3:] == (None, 5.0)
