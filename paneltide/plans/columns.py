"""Column functions: dates, text, names, nested values, envelopes, files, types."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions import changes, dates, describe, dtypes, envelopes, files, kinds, names, nested, text
from paneltide.operators import validate
from paneltide.plans.registry import query
from paneltide.schema import parse_type, type_hint

_ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"

# --- dates ----------------------------------------------------------------------------


@query(
    "ensure_utc_to_milli_to_iso",
    f"""SELECT event_id, ts AS utc, date_trunc('milliseconds', ts) AS milli, strftime(ts, {_ISO}) AS iso FROM events""",
)
def utc_milli_iso(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", dates.ensure_utc(ts).alias("utc"), dates.to_milli(ts).alias("milli"), dates.to_iso(ts).alias("iso")
    )


def _written(t):
    """Event times written in five ways, one per event type."""
    ts = F.col("ts").cast("timestamp")
    shifted = ts + F.expr("INTERVAL 330 MINUTES")
    written = (
        F.when(F.col("event_type") == "click", dates.to_iso(ts))
        .when(F.col("event_type") == "view", F.concat(F.date_format(shifted, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+05:30")))
        .when(F.col("event_type") == "purchase", F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(F.col("event_type") == "signup", F.date_format(ts, "yyyyMMdd"))
        .otherwise(F.concat(F.lit("about "), F.date_format(ts, "yyyy")))
    )
    return t.events.select("event_id", "event_type", "value", "ts", written.alias("written"))


_PARSED = """CASE event_type WHEN 'click' THEN ts WHEN 'view' THEN date_trunc('milliseconds', ts)
  WHEN 'purchase' THEN CAST(date_trunc('second', ts) AS TIMESTAMP)
  WHEN 'signup' THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END"""


@query("parse_datetime", f"SELECT event_id, {_PARSED} AS parsed FROM events")
def parse_datetime(t):
    return _written(t).select("event_id", dates.parse_datetime(F.col("written")).alias("parsed"))


def _nested(t):
    return _written(t).select(
        "event_id",
        F.struct(
            F.col("written").alias("text"), F.array("ts", F.lit(None).cast("timestamp_ntz")).alias("times"),
            F.create_map("event_type", "written").alias("by_type"),
        ).alias("doc"),
    )


_TEXT_OR_ISO = f"coalesce(strftime({_PARSED}, {_ISO}), 'about ' || strftime(ts, '%Y'))"


@query(
    "normalize_iso",
    f"SELECT event_id, {_TEXT_OR_ISO} AS text, strftime(ts, {_ISO}) AS first_time, {_TEXT_OR_ISO} AS by_type FROM events",
)
def normalize_iso(t):
    out = nested.normalize_iso(_nested(t), ["doc"])
    return out.select("event_id", "doc.text", F.col("doc.times")[0].alias("first_time"),
                      F.map_values("doc.by_type")[0].alias("by_type"))


_OTHER = "CASE WHEN event_type = 'error' THEN 'about ' || strftime(ts, '%Y') END"


@query(
    "normalize_datetimes",
    f"""SELECT event_id, date_trunc('milliseconds', {_PARSED}) AS value, {_OTHER} AS text,
        date_trunc('milliseconds', ts) AS first_time FROM events""",
)
def normalize_datetimes(t):
    out = nested.normalize_datetimes(_nested(t), ["doc"])
    return out.select("event_id", "doc.text.value", "doc.text.text", F.col("doc.times")[0].alias("first_time"))


@query(
    "to_epoch_seconds",
    f"""SELECT event_id, epoch_us({_PARSED}) / 1e6 AS value, {_OTHER} AS text, epoch_us(ts) / 1e6 AS first_time
        FROM events""",
)
def to_epoch_seconds(t):
    out = nested.to_epoch_seconds(_nested(t), ["doc"])
    return out.select("event_id", "doc.text.value", "doc.text.text", F.col("doc.times")[0].alias("first_time"))


def _numbers(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    unit = (
        F.when(F.col("event_type") == "click", us)
        .when(F.col("event_type") == "view", F.floor(us / 1000))
        .otherwise(F.floor(us / 1_000_000))
    )
    return t.events.select("event_id", "event_type", unit.alias("n"))


@query(
    "normalize_epoch",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN epoch_us(ts) / 1e6 WHEN 'view' THEN (epoch_us(ts) // 1000) / 1e3
        ELSE CAST(epoch_us(ts) // 1000000 AS DOUBLE) END AS seconds FROM events""",
)
def normalize_epoch(t):
    return _numbers(t).select("event_id", dates.normalize_epoch(F.col("n")).alias("seconds"))


@query(
    "from_epoch",
    """SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('milliseconds', ts)
        WHEN 'view' THEN date_trunc('milliseconds', ts)
        WHEN 'error' THEN NULL ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS moment,
        event_type = 'error' AS open_end FROM events""",
)
def from_epoch(t):
    # Errors ask for a time far beyond the calendar, which gives the open upper bound.
    n = F.when(F.col("event_type") == "error", F.lit(9e18)).otherwise(F.col("n").cast("double"))
    moment = dates.from_epoch(n)
    is_open = dates.datetimes_close(moment, dates.datetime_max())
    return _numbers(t).select(
        "event_id", F.when(~is_open, moment).alias("moment"), is_open.alias("open_end")
    )


@query(
    "datetimes_close",
    """SELECT event_id, abs(epoch_us(ts) - epoch_us(date_trunc('milliseconds', ts))) <= 1000 AS near,
        abs(epoch_us(ts) - epoch_us(date_trunc('second', ts))) <= 1000 AS near_second FROM events""",
)
def datetimes_close(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id", dates.datetimes_close(ts, dates.to_milli(ts)).alias("near"),
        dates.datetimes_close(ts, F.date_trunc("second", ts)).alias("near_second"),
    )


# --- text -----------------------------------------------------------------------------


@query(
    "edit_distance",
    """SELECT p_partkey, levenshtein(p_name, lower(p_type)) / (length(p_name) + length(p_type)) AS distance FROM part""",
)
def edit_distance(t):
    return t.part.select("p_partkey", text.edit_distance(F.col("p_name"), F.lower("p_type")).alias("distance"))


@query(
    "common_substring_length",
    """SELECT p_partkey, CAST(list_max(list_transform(range(1, length(p_name) + 1), lambda i:
         list_max(list_transform(range(i, length(p_name) + 1), lambda j:
           CASE WHEN contains(lower(p_type || ' ' || p_brand), p_name[i:j]) THEN j - i + 1 ELSE 0 END)))) AS INTEGER)
         AS shared
       FROM part""",
)
def common_substring_length(t):
    return t.part.select(
        "p_partkey",
        text.common_substring_length_short(F.col("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_brand"))).alias("shared"),
    )


@query("common_substring_turns")
def common_substring_turns(t):
    """Each turn against the turn before it, whole texts."""
    now = t.conversations.select("conv_id", "turn", "text")
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    pairs = now.join(before, ["conv_id", "turn"], "left")
    return pairs.select("conv_id", "turn", text.common_substring_length(F.col("text"), F.col("previous")).alias("shared"))


_LINES = r"""regexp_split_to_array(regexp_replace({0}, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"""


@query(
    "dedent",
    f"""WITH d AS (SELECT doc_id, '    ' || replace(text, chr(10), chr(10) || '      ') AS body FROM documents),
    l AS (SELECT doc_id, body, {_LINES.format('body')} AS lines FROM d),
    m AS (SELECT doc_id, body, lines, list_min([length(x) - length(regexp_replace(x, '^\\s+', '')) FOR x IN lines
                                       IF regexp_replace(x, '^\\s+', '') <> '']) AS indent FROM l)
    SELECT doc_id, CASE WHEN coalesce(indent, 0) = 0 THEN body ELSE
      array_to_string([CASE WHEN regexp_replace(x, '^\\s+', '') = '' THEN '' ELSE substr(x, indent + 1) END FOR x IN lines], chr(10))
      END AS body FROM m""",
)
def dedent(t):
    body = F.concat(F.lit("    "), F.replace("text", F.lit("\n"), F.lit("\n      ")))
    return t.documents.select("doc_id", text.dedent(body).alias("body"))


@query(
    "drop_import_lines",
    f"""WITH d AS (SELECT doc_id, 'import os' || chr(10) || '  from x import y' || chr(10) || text AS body FROM documents),
    l AS (SELECT doc_id, {_LINES.format('body')} AS lines FROM d)
    SELECT doc_id,
      regexp_replace(array_to_string([x FOR x IN lines IF NOT starts_with(x, 'import ') AND NOT starts_with(x, 'from ')],
        chr(10)), '^\\s+|\\s+$', '', 'g') AS top_only,
      regexp_replace(array_to_string([x FOR x IN lines IF NOT regexp_matches(x, '^\\s*(import|from) ')], chr(10)),
        '^\\s+|\\s+$', '', 'g') AS everywhere
    FROM l""",
)
def drop_import_lines(t):
    body = F.concat(F.lit("import os\n  from x import y\n"), F.col("text"))
    return t.documents.select(
        "doc_id", text.drop_import_lines(body, top_only=True).alias("top_only"),
        text.drop_import_lines(body).alias("everywhere"),
    )


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 250) || chr(10) || '...' || chr(10) || right(text, 250)
        || chr(10) || chr(10) || 'Value too large to show. This is it''s data format:' || chr(10) || chr(10)
        || '{"type":"string"}' ELSE text END AS preview
       FROM documents""",
)
def preview(t):
    note = describe.descriptor(F.col("text"), T.StringType())
    return t.documents.select("doc_id", text.preview(F.col("text"), note).alias("preview"))


@query(
    "to_readable",
    """SELECT p_partkey, '{' || chr(10) || '  "p_name": "' || p_name || '",' || chr(10) || '  "p_size": ' || p_size || ',' ||
        chr(10) || '  "tags": [' || chr(10) || '    "' || p_brand || '",' || chr(10) || '    null' || chr(10) || '  ]' || chr(10) || '}'
        AS readable FROM part""",
)
def to_readable(t):
    doc = t.part.select(
        "p_partkey", F.struct("p_name", "p_size", F.array("p_brand", F.lit(None).cast("string")).alias("tags")).alias("doc")
    )
    return doc.select("p_partkey", nested.to_readable(F.col("doc"), doc.schema["doc"].dataType).alias("readable"))


@query(
    "string_keys",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, o_totalprice AS v FROM orders
       UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), -o_totalprice FROM orders WHERE o_orderkey <> o_custkey""",
)
def string_keys(t):
    pairs = F.map_from_entries(
        F.filter(
            F.array(F.struct("o_custkey", "o_totalprice"), F.struct(F.col("o_orderkey").alias("o_custkey"), (-F.col("o_totalprice")).alias("o_totalprice"))),
            lambda e: (e["o_custkey"] != F.col("o_orderkey")) | (e["o_totalprice"] < 0) ,
        )
    )
    same = F.col("o_orderkey") == F.col("o_custkey")
    one = F.create_map("o_custkey", "o_totalprice")
    maps = t.orders.select("o_orderkey", F.struct(F.when(same, one).otherwise(pairs).alias("m")).alias("doc"))
    out = nested.string_keys(maps, ["doc"])
    return out.select("o_orderkey", F.explode("doc.m").alias("k", "v"))


# --- names ----------------------------------------------------------------------------


def _names(t):
    part = t.part.select(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("'s")).alias("name"))
    return part.unionAll(t.customer.select("c_name")).unionAll(t.pages.select("url")).unionAll(
        t.documents.select(F.col("text").alias("name"))
    )


_NAMES_SQL = """names AS (SELECT p_size || ' ' || p_name || '''s' AS name FROM part UNION ALL SELECT c_name FROM customer
  UNION ALL SELECT url FROM pages UNION ALL SELECT text FROM documents)"""


@query(
    "names",
    rf"""WITH {_NAMES_SQL}, c AS (SELECT name, regexp_replace(name, '[^\w\x{{00A0}}-\x{{FFFF}}]', '', 'g') AS kept FROM names)
    SELECT sha256(name) AS name_hash, regexp_matches(name, '^[a-zA-Z0-9_]+$') AS is_component,
      CASE WHEN kept = '' THEN '_' WHEN regexp_matches(kept, '^\d') THEN '_' || kept ELSE kept END AS cleaned,
      NOT regexp_matches(name, '[''"\\`“”‘’´.]') AS is_valid
    FROM c""",
)
def names_query(t):
    c = F.col("name")
    return _names(t).select(
        F.sha2(c, 256).alias("name_hash"), names.is_component_name(c).alias("is_component"),
        names.clean_name(c).alias("cleaned"), names.is_valid_name(c).alias("is_valid"),
    )


@query(
    "strip_characters",
    """SELECT p_partkey, p_name AS stripped FROM part""",
)
def strip_characters(t):
    wrapped = F.concat(F.lit(" \"'“`. "), "p_name", F.lit(".’´\\ \t"))
    return t.part.select("p_partkey", names.strip_characters(wrapped).alias("stripped"))


@query(
    "clean_full_names",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type || '.' || p_name || '.' || p_brand END AS full_name,
        CASE WHEN p_size % 3 = 0 THEN 'Node names cannot contain, periods, quotes or escape ' || chr(10) || 'characters. Got: '
          || p_type || '.' || '"' || p_name || '". ' || p_brand END AS error FROM part""",
)
def clean_full_names(t):
    quote = F.when(F.col("p_size") % 3 == 0, F.lit('"'))
    path = F.when(
        F.col("p_size") % 3 == 0, F.concat("p_type", F.lit("."), quote, "p_name", quote, F.lit(". "), "p_brand")
    ).otherwise(F.concat(F.lit(" "), "p_type", F.lit(" . "), "p_name", F.lit(".\t"), "p_brand"))
    return t.part.select(
        "p_partkey", names.clean_full_names(path).alias("full_name"), names.full_name_error(path).alias("error")
    )


@query(
    "is_cell_code",
    """SELECT p_partkey, p_size % 2 = 0 AS is_cell FROM part""",
)
def is_cell_code(t):
    code = F.concat(F.when(F.col("p_size") % 2 == 0, F.upper(F.substring("p_name", 1, 2))).otherwise(F.substring("p_name", 1, 2)), "p_size")
    return t.part.select("p_partkey", names.is_cell_code(code).alias("is_cell"))


@query(
    "parse_object_uri",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS bucket,
         regexp_extract(url, '^https?://[^/]*/?(.*)$', 1) AS path FROM pages""",
)
def parse_object_uri(t):
    uri = names.parse_object_uri(F.regexp_replace("url", "^https?://", "gs://"))
    return t.pages.select("page_id", uri["bucket"].alias("bucket"), uri["path"].alias("path"))


@query(
    "dtype_name",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unicode_' WHEN 1 THEN 'string_' WHEN 2 THEN 'object' ELSE 'int64' END
        AS dtype FROM part""",
)
def dtype_name(t):
    code = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("<U"), F.length("p_name").cast("string")))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit("|S"), F.col("p_size").cast("string")))
        .when(F.col("p_size") % 4 == 2, F.lit("|O")).otherwise(F.lit("int64"))
    )
    return t.part.select("p_partkey", dtypes.dtype_name(code).alias("dtype"))


@query(
    "cast_columns",
    """SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part""",
)
def cast_columns(t):
    return dtypes.cast_columns(t.part.select("p_partkey", "p_size", "p_retailprice"), {"p_size": "uint8", "p_retailprice": "float32"})


# --- messages, envelopes, documents, files -----------------------------------------------


@query(
    "change_field",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def change_field(t):
    c = F.col("props")
    return t.events.select(
        "event_id", changes.change_field(c, "$.k", "bigint").alias("k"), changes.change_field(c, "$.a.b").alias("missing")
    )


@query(
    "schema_hash",
    """SELECT event_id, substr(sha256(props), 1, 8) AS schema_hash FROM events""",
)
def schema_hash(t):
    return t.events.select("event_id", describe.schema_hash(F.col("props")).alias("schema_hash"))


_LIST_HASH = """substr(sha256('{{"items":[' || array_to_string(list_transform(range({0}), lambda x: '"' ||
   substr(sha256('{{"type":"number"}}'), 1, 8) || '"'), ',') || '],"maxItems":' || {0} || ',"minItems":' || {0} ||
   ',"type":"array","x-type":"list"}}'), 1, 8)"""


@query(
    "value_schema",
    f"""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN n < 32 THEN {_LIST_HASH.format('n')} ELSE
      substr(sha256('{{"items":"' || substr(sha256('{{"type":"number"}}'), 1, 8) || '","maxItems":' || n || ',"minItems":' || n ||
      ',"type":"array","x-type":"list"}}'), 1, 8) END AS schema_hash FROM n""",
)
def value_schema(t):
    """Descriptor hash of each order's list of quantities."""
    return _quantity_schemas(t, "l_orderkey", F.col("l_quantity"))


def _quantity_schemas(t, key, quantity):
    items = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", quantity.alias("q"))))
    listed = t.lineitem.groupBy(key).agg(F.transform(items, lambda e: e["q"]).alias("v"))
    return listed.select(key, describe.schema_hash(describe.descriptor(F.col("v"), listed.schema["v"].dataType)).alias("schema_hash"))


@query(
    "value_schema_suppliers",
    """WITH i AS (SELECT l_suppkey, '"' || substr(sha256(CASE WHEN l_returnflag = 'R' THEN '{"type":"null"}' ELSE '{"type":"number"}' END), 1, 8)
        || '"' AS h, l_returnflag = 'R' AS missing, l_orderkey, l_linenumber FROM lineitem),
      g AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT h) AS kinds, min(h) AS one,
        string_agg(h, ',' ORDER BY l_orderkey, l_linenumber, missing DESC) AS hs FROM i GROUP BY l_suppkey)
    SELECT l_suppkey, substr(sha256('{"items":' || CASE WHEN n >= 32 AND kinds = 1 THEN one ELSE '[' || hs || ']' END ||
      ',"maxItems":' || n || ',"minItems":' || n || ',"type":"array","x-type":"list"}'), 1, 8) AS schema_hash FROM g""",
)
def value_schema_suppliers(t):
    """The same of each supplier's quantities, those of returned items missing: long lists of mixed items."""
    return _quantity_schemas(t, "l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")))


_NUMBER_HASH = """substr(sha256('{"type":"number"}'), 1, 8)"""
_PAIR = """'{{"properties":{{"key":"' || substr(sha256('{{"type":"string"}}'), 1, 8) || '","value":"' || {0} ||
  '"}},"required":["key","value"],"type":"object","x-type":"key-value-pair"}}'"""


@query(
    "schema_definitions",
    f"""WITH n AS (SELECT DISTINCT count(*) AS n FROM lineitem GROUP BY l_orderkey),
    lists AS (SELECT '{{"items":[' || array_to_string(list_transform(range(n), lambda x: '"' || {_NUMBER_HASH} || '"'), ',') ||
      '],"maxItems":' || n || ',"minItems":' || n || ',"type":"array","x-type":"list"}}' AS d FROM n),
    pairs AS (SELECT {_PAIR.format('substr(sha256(d), 1, 8)')} AS d FROM lists),
    dicts AS (SELECT '{{"properties":{{"items":"' || substr(sha256(d), 1, 8) || '"}},"required":["items"],"type":"object","x-length":1,"x-type":"dict"}}' AS d FROM pairs),
    a AS (SELECT d, 1 AS n FROM lists UNION ALL SELECT d, 2 FROM pairs UNION ALL SELECT d, 1 FROM dicts
      UNION ALL SELECT '{{"type":"string"}}', 0 UNION ALL SELECT '{{"type":"number"}}', 0)
    SELECT substr(sha256(d), 1, 8) AS schema_hash, d AS definition, n AS named, n AS opened FROM a""",
)
def schema_definitions(t):
    """All descriptors of the orders' documents {items: quantities}, and how many of the hashes each names are defined."""
    listed = t.lineitem.groupBy("l_orderkey").agg(F.struct(F.collect_list("l_quantity").alias("items")).alias("doc"))
    known = describe.schema_definitions(listed, ["doc"])
    named = known.select("schema_hash", "definition", F.explode_outer(describe.references(F.col("definition"))).alias("named"))
    hashes = known.select(F.col("schema_hash").alias("known_hash")).distinct()
    return named.join(hashes, F.col("named") == F.col("known_hash"), "left").groupBy("schema_hash", "definition").agg(
        F.count("named").cast("int").alias("named"), F.count("known_hash").cast("int").alias("opened")
    )


@query(
    "pack_value",
    """SELECT p_partkey, '{"__kind__": "dict", "data": [[{"__kind__": "str", "data": "p_name"}, {"__kind__": "str", "data": "'
        || p_name || '"}], [{"__kind__": "str", "data": "p_size"}, {"__kind__": "int", "data": ' || p_size ||
        '}], [{"__kind__": "str", "data": "tags"}, {"__kind__": "list", "data": [{"__kind__": "str", "data": "' || p_brand ||
        '"}, {"__kind__": "NoneType", "data": null}]}]]}' AS packed FROM part""",
)
def pack_value(t):
    doc = _part_documents(t)
    return doc.select("p_partkey", envelopes.pack_value(F.col("doc"), doc.schema["doc"].dataType).alias("packed"))


def _part_documents(t):
    return t.part.select(
        "p_partkey", F.struct("p_name", "p_size", F.array("p_brand", F.lit(None).cast("string")).alias("tags")).alias("doc")
    )


@query(
    "unpack_value",
    """SELECT event_id, 'dict' AS kind, event_type, value, date_trunc('milliseconds', ts) AS ts,
        CAST(user_id AS BIGINT) AS first_item, user_id + 1 AS second_item FROM events""",
)
def unpack_value(t):
    doc = t.events.select(
        "event_id", F.struct("event_type", "value", F.col("ts").cast("timestamp").alias("ts"),
                             F.array("user_id", F.col("user_id") + 1).alias("items")).alias("doc")
    )
    dtype = doc.schema["doc"].dataType
    packed = doc.select("event_id", envelopes.pack_value(F.col("doc"), dtype).alias("packed"))
    opened = packed.select("event_id", envelopes.kind(F.col("packed")).alias("kind"), envelopes.unpack_value(F.col("packed"), dtype).alias("v"))
    return opened.select("event_id", "kind", "v.event_type", "v.value", "v.ts", F.col("v.items")[0].alias("first_item"),
                         F.col("v.items")[1].alias("second_item"))


@query("unpack_frame", "SELECT l_orderkey AS o_orderkey, l_linenumber AS index, l_quantity, l_returnflag FROM lineitem")
def unpack_frame(t):
    """Line items as table values and back."""
    dtype = T.StructType([T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType())])
    row = envelopes.pack_frame_row(F.col("l_linenumber"), T.IntegerType(), F.struct("l_quantity", "l_returnflag"), dtype)
    # One envelope per line: a table value may be split over chunk rows of any number.
    frames = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.concat(F.lit('{"__kind__": "DataFrame", "data": ['), row, F.lit("]}")).alias("frame"),
    )
    return envelopes.unpack_frame(frames, "frame", T.IntegerType(), dtype)


_MIXED = {
    "ndarray": ("'[[' || p_size || ',1],[2,3]]'", "NULL", "'int64'", "'2,2'", "NULL"),
    "Series": ("'[' || p_size || ',' || (p_size + 1) || ']'", """'["a","b"]'""", "NULL", "NULL", "NULL"),
    "Period": ("""'"2020-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '"'""", "NULL", "NULL", "NULL", "'M'"),
    "PeriodIndex": ("""'["' || (1970 + p_size) || '","1969"]'""", "NULL", "NULL", "NULL", "'Y'"),
    "Timestamp": ("""'"2020-01-01T00:00:00.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || 'Z"'""", "NULL", "NULL", "NULL", "NULL"),
    "time": ("""'"12:' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':00"'""", "NULL", "NULL", "NULL", "NULL"),
    "Index": ("""'[' || p_size || ',7]'""", "NULL", "NULL", "NULL", "NULL"),
    "tuple": ("""'["' || p_brand || '",' || p_size || ',null]'""", "NULL", "NULL", "NULL", "NULL"),
    "ObjectId": ("""'"' || lpad(CAST(p_partkey AS VARCHAR), 24, '0') || '"'""", "NULL", "NULL", "NULL", "NULL"),
    "complex": ("""'{"im":-2,"re":' || p_size || '}'""", "NULL", "NULL", "NULL", "NULL"),
    "dict": ("""'{"k":[' || p_size || ']}'""", "NULL", "NULL", "NULL", "NULL"),
}
_MIXED_CASES = [
    " ".join(f"WHEN {i} THEN {case[n]}" for i, case in enumerate(_MIXED.values())) for n in range(5)
]


@query(
    "open_any",
    f"""SELECT p_partkey, ({list(_MIXED)})[p_partkey % {len(_MIXED)} + 1] AS kind,
    """ + ", ".join(f"CASE p_partkey % {len(_MIXED)} {cases} END AS {name}" for cases, name in zip(_MIXED_CASES, ("value", "labels", "dtype", "shape", "freq")))
    + " FROM part",
)
def open_any(t):
    """One column of envelopes of eleven kinds, opened by the kind each one names."""
    size = F.col("p_size").cast("int")
    whole, text = T.IntegerType(), T.StringType()
    month = F.make_date(F.lit(2020), F.pmod(size, F.lit(12)) + 1, F.lit(1))
    padded = F.lpad(size.cast("string"), 2, "0")
    packed = {
        "ndarray": envelopes.pack_array(F.array(F.array(size, F.lit(1)), F.array(F.lit(2), F.lit(3))), T.ArrayType(T.ArrayType(whole)), "int64"),
        "Series": envelopes.pack_series(F.array(F.lit("a"), F.lit("b")), text, F.array(size, size + 1), whole),
        "Period": envelopes.pack_period(month, "M"),
        "PeriodIndex": envelopes.pack_periods(F.array(F.make_date(1970 + size, F.lit(5), F.lit(2)), F.lit("1969-12-31").cast("date")), "Y"),
        "Timestamp": envelopes.pack_as("Timestamp", F.concat(F.lit("2020-01-01T00:00:00."), F.lpad(size.cast("string"), 3, "0"), F.lit("Z"))),
        "time": envelopes.pack_as("time", F.concat(F.lit("12:"), padded, F.lit(":00"))),
        "Index": envelopes.pack_index(F.array(size, F.lit(7)), whole),
        "tuple": envelopes.pack_tuple([(F.col("p_brand"), text), (size, whole), (F.lit(None), T.NullType())]),
        "ObjectId": envelopes.pack_as("ObjectId", F.lpad(F.col("p_partkey").cast("string"), 24, "0")),
        "complex": envelopes.pack_as("complex", F.concat(size.cast("string"), F.lit("-2j"))),
        "dict": envelopes.pack_value(F.struct(F.array(size).alias("k")), T.StructType([T.StructField("k", T.ArrayType(whole))])),
    }
    kind = F.pmod(F.col("p_partkey"), F.lit(len(packed)))
    chosen = F.coalesce(*[F.when(kind == list(_MIXED).index(k), c) for k, c in packed.items()])
    opened = t.part.select("p_partkey", kinds.open_any(chosen).alias("o"))
    return opened.select(
        "p_partkey", "o.kind", F.to_json("o.value").alias("value"), F.to_json("o.labels").alias("labels"), "o.dtype",
        F.array_join(F.col("o.shape").cast("array<string>"), ",").alias("shape"), "o.freq",
    )


@query(
    "plain_document",
    """SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS customer, o_orderstatus AS status FROM orders""",
)
def plain_document(t):
    nested_docs = t.orders.select(
        F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("$oid")).alias("_id"),
        F.struct(
            F.struct(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("$oid")).alias("id"),
                     F.lit("x").alias("secret")).alias("customer"),
            F.col("o_orderstatus").alias("status"), F.lit("y").alias("secret"),
        ).alias("body"),
        F.lit("z").alias("secret"),
    )
    out = nested.plain_document(nested_docs, ignore=["secret"], references=["customer"])
    assert "secret" not in out.columns and out.schema["body"].dataType.fieldNames() == ["customer", "status"]
    return out.select(F.col("_id").alias("id"), "body.customer", "body.status")


_TYPE = r"""CASE WHEN regexp_matches({0}, '^\s*[\[{{]') THEN 'json' WHEN contains({0}, ',') THEN 'csv'
  WHEN contains({0}, chr(9)) THEN 'tsv' ELSE 'txt' END"""


@query(
    "guess_file_type",
    f"""SELECT 'd' || doc_id AS id, {_TYPE.format('text')} AS file_type FROM documents
        UNION ALL SELECT 'p' || page_id, {_TYPE.format('html')} FROM pages
        UNION ALL SELECT 'e' || event_id, {_TYPE.format('props')} FROM events
        UNION ALL SELECT 'z' || doc_id, CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'pdf'
          WHEN 4 THEN 'xls' WHEN 5 THEN 'docx' ELSE 'bin' END FROM documents""",
)
def guess_file_type(t):
    def typed(df, letter, key, content):
        return df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"),
                         files.guess_file_type(content).alias("file_type"))

    heads = F.array(*[F.unhex(F.lit(h)) for h in (
        "89504E470D0A1A0A", "FFD8FF", "474946383961", "25504446", "D0CF11E0A1B11AE1", "504B0304", "FFFE")])
    kind = (F.col("doc_id") % 7).cast("int")
    inner = F.when(kind == 5, F.lit("[Content_Types].xml word/")).otherwise(F.lit("")).cast("binary")
    signed = F.concat(F.element_at(heads, kind + 1), inner, F.col("text").cast("binary"))
    out = typed(t.documents, "d", "doc_id", F.col("text").cast("binary"))
    out = out.unionAll(typed(t.pages, "p", "page_id", F.col("html").cast("binary")))
    out = out.unionAll(typed(t.events, "e", "event_id", F.col("props").cast("binary")))
    return out.unionAll(typed(t.documents, "z", "doc_id", signed))


# --- types and checks -----------------------------------------------------------------


@query(
    "describe_json",
    """SELECT 'OBJECT<k: BIGINT>' AS schema, count(props) AS n_valid, count(*) - count(props) AS n_invalid FROM events""",
)
def describe_json(t):
    return describe.describe_json(t.events, "props")


@query(
    "check_allowed",
    """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'age']) AS name,
         unnest([true, true, true, true, true, true, false]) AS valid, count(*) AS n FROM orders""",
)
def check_allowed(t):
    aged = t.orders.withColumn("age", F.lit("2024-01-01").cast("timestamp_ntz") - F.col("o_orderdate"))
    verdicts = F.array(*[
        F.struct(F.lit(f.name).alias("name"), validate.check_allowed_value(F.col(f.name), f.dataType)["valid"].alias("valid")) for f in aged.schema
    ])
    return aged.select(F.inline(verdicts)).groupBy("name").agg(F.bool_and("valid").alias("valid"), F.count("*").alias("n"))


@query(
    "check_typed",
    """SELECT event_id, regexp_matches(w, '^-?[0-9]+$') AS is_int,
         CASE WHEN regexp_matches(w, '^-?[0-9]+$') THEN '' ELSE 'value ''' || w || ''' is not of allowed type int' END AS message
       FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE CAST(user_id AS VARCHAR) END AS w FROM events)""",
)
def check_typed(t):
    word = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    verdict = validate.check_typed(word, "int")
    return t.events.select("event_id", verdict["valid"].alias("is_int"), verdict["message"].alias("message"))


@query(
    "parse_type",
    """SELECT o_orderkey, 'List[int]' AS hint, o_custkey AS first_item, o_custkey + 1 AS second_item FROM orders""",
)
def parse_type_query(t):
    """JSON text read with the Spark type of a declared hint."""
    dtype = parse_type("List[int]")
    body = F.concat(F.lit("["), F.col("o_custkey"), F.lit(", "), F.col("o_custkey") + 1, F.lit("]"))
    read = t.orders.select("o_orderkey", F.from_json(body, dtype).alias("v"))
    return read.select("o_orderkey", F.lit(type_hint(dtype)).alias("hint"), F.col("v")[0].alias("first_item"),
                       F.col("v")[1].alias("second_item"))


@query(
    "check_output",
    """SELECT p_partkey, p_size % 3 <> 0 AS spec_ok, p_size % 3 <> 1 AS params_ok, p_size % 4 > 1 AS ranges_ok FROM part""",
)
def check_output(t):
    cell = F.when(F.col("p_size") % 3 == 0, F.lit("a1")).otherwise(F.concat(F.lit("A"), "p_size"))
    spec = F.to_json(F.struct(F.lit("int").alias("value_type"), cell.alias("start_cell")))
    params = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"x": ['), "p_size", F.lit("]}"))).otherwise(
        F.concat(F.lit('{"x": '), "p_size", F.lit("}")))
    at = F.timestamp_seconds(F.col("p_partkey"))
    # Some ranges have no end, and some lists of ranges are missing.
    end = F.when(F.col("p_size") % 4 != 0, at)
    ranges = F.when(F.col("p_size") % 4 != 1, F.array(F.struct(at.alias("tr_start"), at.alias("tr_end")), F.struct(at.alias("tr_start"), end.alias("tr_end"))))
    return t.part.select(
        "p_partkey", validate.check_export_spec(spec)["valid"].alias("spec_ok"),
        validate.check_sim_params(params)["valid"].alias("params_ok"),
        validate.check_time_ranges(ranges)["valid"].alias("ranges_ok"),
    )


@query(
    "check_output_lists",
    f"""SELECT p_partkey,
      CASE p_size % 4 WHEN 0 THEN '{{"x":' || p_size || '}}{validate.NOT_LIST}' WHEN 1 THEN '[' || p_size || ']{validate.NOT_HASHABLE}'
        WHEN 2 THEN p_size || '{validate.NOT_DICT}' ELSE '' END AS params_message,
      CASE p_size % 3 WHEN 0 THEN 'b' || p_size || '{validate.NOT_CELL}' WHEN 1 THEN '[]{validate.NOT_DICT}' ELSE '' END AS export_message,
      p_size % 5 > 1 AS ranges_ok FROM part""",
)
def check_output_lists(t):
    """Lists of parameters, export entries by sheet and named lists of ranges, good and bad ones, with the reasons."""
    size = F.col("p_size").cast("string")
    good = F.concat(F.lit('{"x":'), size, F.lit("}"))
    params = (
        F.when(F.col("p_size") % 4 == 0, good).when(F.col("p_size") % 4 == 1, F.concat(F.lit("["), good, F.lit(',{"y":['), size, F.lit("]}]")))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("["), size, F.lit(","), good, F.lit("]"))).otherwise(F.concat(F.lit("["), good, F.lit("]")))
    )
    entry = lambda cell: F.concat(F.lit('{"value_type":"int","start_cell":"'), cell, F.lit('"}'))
    second = F.when(F.col("p_size") % 3 == 0, entry(F.concat(F.lit("b"), size))).otherwise(entry(F.concat(F.lit("B"), size)))
    export = F.when(F.col("p_size") % 3 == 1, F.lit("[]")).otherwise(F.concat(F.lit('{"one":'), entry(F.lit("A1")), F.lit(',"two":'), second, F.lit("}")))
    at = F.timestamp_seconds(F.col("p_partkey"))
    whole = F.array(F.struct(at.alias("tr_start"), at.alias("tr_end")))
    open_end = F.array(F.struct(at.alias("tr_start"), F.lit(None).cast("timestamp").alias("tr_end")))
    named = F.when(F.col("p_size") % 5 != 1, F.create_map(F.lit("all"), whole, F.lit("valid"), F.when(F.col("p_size") % 5 == 0, open_end).otherwise(whole)))
    return t.part.select(
        "p_partkey", validate.check_all_sim_params(params)["message"].alias("params_message"),
        validate.check_export_config(export)["message"].alias("export_message"), validate.check_all_time_ranges(named)["valid"].alias("ranges_ok"),
    )


@query(
    "quarantine",
    """SELECT event_id, event_type = 'error' AS rejected,
         CASE WHEN event_type = 'error' THEN 'value ''error'' is not of allowed type int' END AS message FROM events""",
)
def quarantine(t):
    word = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    good, bad = validate.quarantine(t.events, validate.check_typed(word, "int"))
    return good.select("event_id", F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("message")).unionAll(
        bad.select("event_id", F.lit(True).alias("rejected"), "message")
    )
