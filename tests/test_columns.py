"""Names, nested values, descriptors, envelopes, messages, types."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide import schema
from paneltide.functions import changes, describe, dtypes, envelopes, names, nested
from paneltide.operators import validate


def test_names(spark):
    rows = [("a b", "ab"), ("1x", "_1x"), ("--", "_"), ("é_9", "é_9"), ("x.y", "xy")]
    df = spark.createDataFrame(rows, "n string, want string")
    assert all(r.want == r.got for r in df.select("want", names.clean_name(F.col("n")).alias("got")).collect())
    checks = spark.createDataFrame([("ab_1", True, True), ("a b", False, True), ("a.b", False, False), ("a`", False, False)],
                                   "n string, component boolean, valid boolean")
    for r in checks.select("*", names.is_component_name(F.col("n")).alias("c"), names.is_valid_name(F.col("n")).alias("v")).collect():
        assert (r.c, r.v) == (r.component, r.valid)
    full = spark.createDataFrame([(" a . b ",), ("a.'b",)], "n string").select(
        names.clean_full_names(F.col("n")).alias("f"), names.full_name_error(F.col("n")).alias("e")).collect()
    assert full[0].f == "a.b" and full[0].e is None and full[1].f is None and "cannot contain" in full[1].e
    uri = spark.createDataFrame([("gs://b/x/y",), ("gs://b",), ("s3://b",)], "u string").select(
        names.parse_object_uri(F.col("u")).alias("p")).collect()
    assert (uri[0].p.bucket, uri[0].p.path, uri[1].p.path, uri[2].p) == ("b", "x/y", "", None)
    cells = spark.createDataFrame([("A1",), ("AB12",), ("a1",), ("A",)], "c string").select(names.is_cell_code(F.col("c")).alias("ok"))
    assert [r.ok for r in cells.collect()] == [True, True, False, False]


DOC = T.StructType([
    T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.ArrayType(T.DoubleType())),
    T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("e", T.ArrayType(T.StringType())),
])
VALUE = {"a": 1, "b": 'q"x\n', "c": [1.5, None], "m": {"k": 2}, "e": []}


def test_readable_is_indented_json(spark):
    df = spark.createDataFrame([(VALUE,), (None,)], T.StructType([T.StructField("v", DOC)]))
    first, second = [r.t for r in df.select(nested.to_readable(F.col("v"), DOC).alias("t")).collect()]
    assert first == json.dumps(VALUE, indent=2) and second == "null"


def hash_of(value):
    """Descriptor of a plain Python value, hashed."""
    def h(s):
        return hashlib.sha256(json.dumps(s, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]
    if value is None:
        return h({"type": "null"})
    if isinstance(value, dict):
        pairs = {k: h({"type": "object", "x-type": "key-value-pair", "required": ["key", "value"],
                       "properties": {"key": hash_of(k), "value": hash_of(v)}}) for k, v in value.items()}
        return h({"x-type": "dict", "type": "object", "properties": pairs, "x-length": len(value), "required": list(value)})
    if isinstance(value, list):
        items = [hash_of(v) for v in value] if len(value) < 32 else hash_of(value[0])
        return h({"x-type": "list", "type": "array", "items": items, "minItems": len(value), "maxItems": len(value)})
    return h({"type": {int: "integer", float: "number", str: "string"}[type(value)]})


def test_descriptor_hash(spark):
    long = {**VALUE, "c": [0.5] * 40}
    df = spark.createDataFrame([(VALUE,), (long,)], T.StructType([T.StructField("v", DOC)]))
    got = [r.h for r in df.select(describe.schema_hash(describe.descriptor(F.col("v"), DOC)).alias("h")).collect()]
    assert got == [hash_of(VALUE), hash_of(long)]


def test_describe_schema_paths(spark):
    df = spark.createDataFrame([(VALUE,)], T.StructType([T.StructField("v", DOC)]))
    rows = {r.path: r for r in describe.describe_schema(df).collect()}
    assert rows["v.c[]"].schema_hash == hash_of(1.0) and rows["v.a"].type == "bigint" and "$" in rows
    merged = describe.describe_json(spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',), ("{",)], "j string"), "j").first()
    assert (merged.n_valid, merged.n_invalid) == (2, 1) and "a: BIGINT" in merged.schema and "b: STRING" in merged.schema


def test_envelopes_round_trip(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    extra = T.StructType([*DOC.fields, T.StructField("t", T.TimestampType()), T.StructField("d", T.DateType()),
                          T.StructField("x", T.BinaryType()), T.StructField("ok", T.BooleanType())])
    value = {**VALUE, "t": at, "d": at.date(), "x": b"\x00\xff", "ok": True}
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", extra)]))
    packed = df.select("v", envelopes.pack_value(F.col("v"), extra).alias("p"))
    r = packed.select("v", "p", envelopes.unpack_value(F.col("p"), extra).alias("u"), envelopes.kind(F.col("p")).alias("k")).first()
    assert r.u == r.v and r.k == "dict"
    assert json.loads(r.p)["data"][0] == [{"__kind__": "str", "data": "a"}, {"__kind__": "int", "data": 1}]
    bad = spark.createDataFrame([("{",), (None,)], "p string").select(
        envelopes.unpack_value(F.col("p"), T.LongType()).alias("u"), envelopes.unpack_error(F.col("p")).alias("e")).collect()
    assert bad[0].u is None and bad[0].e.startswith("Deserialize failed") and bad[1].e is None


def test_walkers(spark):
    df = spark.sql("""SELECT named_struct('when', '1 Jan 2024 10:00:00 +0200', 'word', 'x', 'ts', timestamp'2024-01-01 00:00:00.0005',
                      'm', map(1, 2.0D, 3, NULL)) AS v""")
    iso = nested.normalize_iso(df).select("v.*").first()
    assert (iso.when, iso.word, iso.ts) == ("2024-01-01T08:00:00.000000Z", "x", "2024-01-01T00:00:00.000500Z")
    assert nested.string_keys(df).select("v.m").first().m == {"1": 2.0, "3": None}
    sec = nested.to_epoch_seconds(df).select("v.*").first()
    assert sec.when.value == 1704096000.0 and sec.word.text == "x" and sec.word.value is None


def test_plain_document(spark):
    df = spark.sql("""SELECT named_struct('$oid', 'abc') AS _id, named_struct('id', named_struct('$oid', 'r1'), 'n', 2) AS owner,
                      array(named_struct('secret', 1, 'x', 2)) AS items, 3 AS secret""")
    out = nested.plain_document(df, ignore=["secret"], references=["owner"])
    r = out.first()
    assert out.columns == ["_id", "owner", "items"] and (r._id, r.owner, r["items"][0].asDict()) == ("abc", "r1", {"x": 2})


def test_change_messages(spark):
    good = json.dumps({"fullDocument": {"calc_graph_ref": {"$oid": "graph123"}, "is_deleted": False}, "documentKey": {"_id": "doc456"},
                       "operationType": "update", "collection": "my_collection"})
    df = spark.createDataFrame([(good,), ('{"collection": "c"}',), ("{",)], "data string")
    c = F.col("data")
    rows = df.select(changes.graph_id(c).alias("g"), changes.document_id(c).alias("i"), changes.operation(c).alias("o"),
                     changes.collection(c).alias("c"), changes.is_deleted(c).alias("d"), changes.change_error(c).alias("e")).collect()
    assert tuple(rows[0]) == ("graph123", "doc456", "update", "my_collection", False, None)
    assert rows[1].e == "missing operationType" and rows[2].e == "not JSON"


def test_type_strings():
    assert schema.parse_type("List[int]") == T.ArrayType(T.LongType())
    nested_type = schema.parse_type("Dict[str, Tuple[int, List[float]]]")
    assert schema.parse_type(schema.type_hint(nested_type)) == nested_type
    assert schema.parse_type("Optional[np.uint64]") == T.DecimalType(20, 0)
    for bad in ("Nope", "List[", "__import__('os')"):
        with pytest.raises(ValueError):
            schema.parse_type(bad)
    with pytest.raises(TypeError):
        schema.parse_type(3)


def test_dtype_names(spark):
    rows = [("<U12", "unicode_"), ("|S3", "string_"), ("|O", "object"), ("int64", "int64"), ("float16", "float16")]
    df = spark.createDataFrame(rows, "d string, want string").select("want", dtypes.dtype_name(F.col("d")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_output_rules(spark):
    def verdicts(rule, texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(rule(F.col("t")).alias("v"))
        return [r.v.valid for r in df.collect()]

    assert verdicts(validate.check_sim_params, ['{"a": 1, "b": "x"}', '{"a": [1]}', "[1]", None]) == [True, False, False, False]
    assert verdicts(validate.check_all_sim_params, ['[{"a": 1}, {"b": 2}]', '[{"a": 1}, [2]]', '{"a": 1}']) == [True, False, False]
    spec = ['{"value_type": "int", "start_cell": "B2"}', '{"value_type": "int", "start_cell": "b2"}', '{"start_cell": "B2"}']
    assert verdicts(validate.check_export_spec, spec) == [True, False, False]
    assert verdicts(validate.check_export_config, ['{"s": %s}' % spec[0], '{"s": %s}' % spec[1]]) == [True, False]
    ranges = spark.sql("SELECT array(named_struct('tr_start', timestamp'2024-01-01', 'tr_end', timestamp'2024-01-02')) r "
                       "UNION ALL SELECT array(named_struct('tr_start', timestamp'2024-01-01', 'tr_end', NULL))")
    assert [r.v.valid for r in ranges.select(validate.check_time_ranges(F.col("r")).alias("v")).collect()] == [True, False]
    good, bad = validate.quarantine(spark.createDataFrame([("1",), ("x",)], "t string"), validate.check_typed(F.col("t"), "int"))
    assert good.count() == 1 and bad.first().message.startswith("value 'x'")
