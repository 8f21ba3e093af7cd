"""Every hash a descriptor names has a definition."""

import json

from pyspark.sql import functions as F

from paneltide.functions import describe


def test_all_hashes_open(spark):
    schema = "k int, v struct<a:string,b:array<struct<x:double,t:timestamp>>,m:map<string,array<int>>,n:map<int,string>,deadbeef:binary>"
    rows = [
        (1, ("q", [(1.0, None), None], {"u": [1, None], "w": []}, {7: "x"}, b"z")), (2, (None, [], {}, None, None)), (3, None),
        (4, ("q", [(2.0, None)] * 40, {str(i): [i] for i in range(40)}, {}, b"")),
    ]
    df = spark.createDataFrame(rows, schema)
    for limit in (None, 32):
        known = {r.schema_hash: json.loads(r.definition) for r in describe.schema_definitions(df, ["v"], limit).collect()}
        named = [r.r for r in describe.schema_definitions(df, ["v"], limit).select(describe.references(F.col("definition")).alias("r")).collect()]
        assert sum(named, []) and {h for r in named for h in r} <= set(known)
        own = df.select(describe.schema_hash(describe.descriptor(F.col("v"), df.schema["v"].dataType, limit)).alias("h"))
        assert {r.h for r in own.collect()} <= set(known)
        assert all(describe.schema_hash_of(d) == h for h, d in known.items())
