"""Whole values: long mixed collections, verdicts on values."""

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions import describe
from paneltide.operators import validate


def one(df, dtype, **options):
    return [r[0] for r in df.select(describe.descriptor(F.col("v"), dtype, **options)).collect()]


def h(schema):
    return hashlib.sha256(json.dumps(schema, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def test_all_items_of_long_lists(spark):
    dtype = T.ArrayType(T.DoubleType())
    df = spark.createDataFrame([([1.0] * 40,), ([1.0] * 39 + [None],), ([1.0] * 31,)], T.StructType([T.StructField("v", dtype)]))
    number, null = h({"type": "number"}), h({"type": "null"})
    assert [json.loads(x)["items"] for x in one(df, dtype)] == [number, [number] * 39 + [null], [number] * 31]
    assert [json.loads(x)["items"] for x in one(df, dtype, limit=describe.MAX_LISTED)] == [number, number, [number] * 31]
    nested = T.ArrayType(dtype)
    df = spark.createDataFrame([([[1.0]] * 39 + [[1.0, 2.0]],)], T.StructType([T.StructField("v", nested)]))
    assert len(set(json.loads(one(df, nested)[0])["items"])) == 2


def test_all_fields_of_wide_structs_and_maps(spark):
    dtype = T.StructType([T.StructField(f"f{i:02}", T.StringType() if i % 2 else T.LongType()) for i in range(40)])
    df = spark.createDataFrame([(tuple("x" if i % 2 else i for i in range(40)),)], T.StructType([T.StructField("v", dtype)]))
    made = json.loads(one(df, dtype)[0])
    assert list(made["properties"]) == dtype.fieldNames() and len(set(made["properties"].values())) == 2
    assert set(json.loads(one(df, dtype, limit=describe.MAX_LISTED)[0])["properties"]) == {"key_schema", "value_schema"}
    dtype = T.MapType(T.StringType(), T.LongType())
    df = spark.createDataFrame([({f"k{i:02}": None if i == 39 else i for i in range(40)},)], T.StructType([T.StructField("v", dtype)]))
    made = json.loads(one(df, dtype)[0])
    assert len(made["properties"]) == 40 and made["properties"]["k39"] != made["properties"]["k00"] == made["properties"]["k38"]


def test_check_allowed_value(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, INTERVAL '1' DAY, array(INTERVAL '1' DAY), map('a', named_struct('x', INTERVAL '1' DAY))), "
        "(2, NULL, array(), map('a', named_struct('x', NULL))), (3, NULL, array(NULL), NULL) AS t(i, d, a, m)"
    )
    got = df.select(*[validate.check_allowed_value(F.col(c), df.schema[c].dataType)["valid"] for c in df.columns]).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (True, True, True, True), (True, True, True, True)]
