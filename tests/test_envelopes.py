"""Envelopes are read by the kind they name."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions import envelopes, kinds

ENVELOPE = {"int": 5, "str": "5", "float": 5.7, "bool": True, "bytes": "aGk=", "datetime": "2023-01-01T12:30:00Z", "date": "2023-01-01", "NoneType": None}


def text_of(kind, data, **more):
    return json.dumps({"__kind__": kind, "data": data, **more})


@pytest.mark.parametrize(
    ("dtype", "opens"),
    [
        (T.LongType(), {"int": 5}), (T.IntegerType(), {"int": 5}), (T.DoubleType(), {"int": 5.0, "float": 5.7}), (T.StringType(), {"str": "5"}),
        (T.BooleanType(), {"bool": True}), (T.BinaryType(), {"bytes": b"hi"}), (T.DateType(), {"date": dt.date(2023, 1, 1)}),
        (T.TimestampType(), {"datetime": dt.datetime(2023, 1, 1, 12, 30)}), (T.ArrayType(T.LongType()), {}), (T.MapType(T.StringType(), T.LongType()), {}),
    ],
)
def test_only_the_asked_kind_opens(spark, dtype, opens):
    rows = [(k, text_of(k, v)) for k, v in ENVELOPE.items()] + [("bad", "{"), ("plain", "5"), ("null", None)]
    out = spark.createDataFrame(rows, "k string, t string").select("k", envelopes.unpack_value(F.col("t"), dtype).alias("v"))
    assert {r.k: bytes(r.v) if isinstance(r.v, bytearray) else r.v for r in out.collect() if r.v is not None} == opens


def test_frames_with_odd_column_names(spark):
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a.b", "c'd", "e]", "$.x", "é f")])
    df = spark.createDataFrame([(1, 2, 3, 4, None)], schema)
    row = envelopes.pack_frame_row(F.lit("i"), T.StringType(), F.struct(*[F.col(f"`{n}`") for n in schema.names]), schema)
    frames = df.select(F.lit(9).alias("k"), F.concat(F.lit('{"__kind__": "DataFrame", "data": ['), row, F.lit("]}")).alias("t"))
    assert [tuple(r) for r in envelopes.unpack_frame(frames, "t", T.StringType(), schema).collect()] == [(9, "i", 1, 2, 3, 4, None)]


def test_every_kind_opens(spark):
    s = lambda x: {"__kind__": "str", "data": x}
    i = lambda x: {"__kind__": "int", "data": x}
    cases = {
        "int": (text_of("int", 123), 123), "str": (text_of("str", "test"), "test"), "none": (text_of("NoneType", None), None),
        "bytes": (text_of("bytes", "aGVsbG8="), "aGVsbG8="), "array": (text_of("ndarray", [i(1), i(2), i(3)], dtype="int64", shape=[3]), [1, 2, 3]),
        "matrix": (text_of("ndarray", [i(k) for k in range(6)], dtype="int64", shape=[3, 2]), [[0, 1], [2, 3], [4, 5]]),
        "cube": (text_of("ndarray", [{"__kind__": "list", "data": [{"__kind__": "list", "data": [i(7)]}]}], dtype="int64", shape=[1, 1, 1]), [[[7]]]),
        "frame": (text_of("DataFrame", [{"index": i(0), "columns": {"a": i(1), "b": s("x")}}]), [{"index": 0, "columns": {"a": 1, "b": "x"}}]),
        "series": (text_of("Series", [{"index": i(0), "value": i(1)}, {"index": i(1), "value": s("q")}]), [1, "q"]),
        "period": (text_of("Period", "2023-01", freq="M"), "2023-01"), "periods": (text_of("PeriodIndex", ["2023-01", "2023-02"], freq="M"), ["2023-01", "2023-02"]),
        "stamp": (text_of("Timestamp", "2023-01-01T12:00:00Z"), "2023-01-01T12:00:00Z"), "index": (text_of("Index", [1, 2, "x"]), [1, 2, "x"]),
        "time": (text_of("time", "12:30:00"), "12:30:00"), "tuple": (text_of("tuple", [i(1), s("b")]), [1, "b"]),
        "dict": (text_of("dict", [[s("a"), i(1)], [i(2), {"__kind__": "tuple", "data": []}]]), {"a": 1, "2": []}),
        "id": (text_of("ObjectId", "0" * 24), "0" * 24), "complex": (text_of("complex", "(1+2j)"), {"re": 1, "im": 2}),
        "nan": (text_of("float", float("nan")), "nan"), "other": (json.dumps({"x": s("y")}), {"x": "y"}), "deep": (text_of("list", [{"__kind__": "list", "data": [s("é")]}]), [["é"]]),
    }
    rows = [(k, t) for k, (t, _) in cases.items()] + [("bad", "{"), ("short", text_of("ndarray", [i(1)], dtype="int64", shape=[2])), ("null", None)]
    out = spark.createDataFrame(rows, "k string, t string").select("k", kinds.open_any(F.col("t")).alias("o"))
    got = {r.k: r for r in out.select("k", "o.kind", F.to_json("o.value").alias("v"), F.to_json("o.labels").alias("l"), "o.dtype", "o.shape", "o.freq", "o.error").collect()}
    for k, (_, want) in cases.items():
        assert (None if got[k].v is None else json.loads(got[k].v)) == want and got[k].error is None, k
    assert got["bad"].error and got["short"].error and got["null"].error is None
    assert (got["matrix"].shape, got["matrix"].dtype, got["periods"].freq, got["series"].l) == ([3, 2], "int64", "M", "[0,1]")


def test_packed_kinds_read_back(spark):
    df = spark.createDataFrame([([[1.5, None], [3.0, 4.0]], ["a", None], dt.datetime(2023, 5, 17, 9, 30)), (None, None, None)], "m array<array<double>>, s array<string>, at timestamp")
    matrix, texts = T.ArrayType(T.ArrayType(T.DoubleType())), T.ArrayType(T.StringType())
    out = df.select(
        envelopes.unpack_value(envelopes.pack_array(F.col("m"), matrix, "float64"), matrix).alias("m"),
        envelopes.unpack_value(envelopes.pack_tuple([(F.get("s", F.lit(0)), T.StringType()), (F.lit("z"), T.StringType())]), texts).alias("t"),
        kinds.open_any(envelopes.pack_array(F.col("m"), matrix, "float64")).alias("o"),
        *[envelopes.unpack_value(envelopes.pack_period(F.col("at"), f), T.StringType()).alias(f"p_{f}") for f in ("Y", "Q", "M", "D", "h", "min", "s")],
        kinds.open_any(envelopes.pack_periods(F.array("at"), "Q")).alias("pi"),
    ).collect()
    a, b = out
    assert (a.m, a.t, a.o.shape) == ([[1.5, None], [3.0, 4.0]], ["a", "z"], [2, 2])
    assert (a.p_Y, a.p_Q, a.p_M, a.p_D, a.p_h, a.p_min, a.p_s) == ("2023", "2023Q2", "2023-05", "2023-05-17", "2023-05-17 09:00", "2023-05-17 09:30", "2023-05-17 09:30:00")
    assert b.m is None and b.p_M is None and b.o.kind == "NoneType" and json.loads(str(a.pi.value.toJson())) == ["2023Q2"]
