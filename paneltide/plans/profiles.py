"""Sources, sinks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import profile
from paneltide.plans.registry import query
from paneltide.session import fresh_path
from paneltide.sources import changes, files

EVENT_FIELDS = "event_id long, event_type string, value double, props string"


@query(
    "read_files",
    """WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines,
      CAST(sum(CAST('0x' || substr(sha256(line), 1, 8) AS BIGINT)) AS BIGINT) AS hash_sum FROM lines GROUP BY source""",
)
def read_files(t):
    """Text files written from the documents: their lengths, and their content line by line as a sum of hashes."""
    root = fresh_path(t.spark, "read_files")
    t.documents.select("source", "text").write.option("maxRecordsPerFile", 1000).partitionBy("source").text(root)
    read = files.read_files(t.spark, root, "*.txt").select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "length", "content")
    text = F.col("content").cast("string")
    # Each file ends with a line end.
    lines = F.split(F.substr(text, F.lit(1), F.char_length(text) - 1), "\n", -1)
    of_line = F.transform(lines, lambda x: F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 8), 16, 10).cast("long"))
    sums = F.aggregate(of_line, F.lit(0).cast("long"), lambda a, h: a + h)
    return read.select("source", "length", F.size(lines).alias("n"), sums.alias("h")).groupBy("source").agg(
        F.sum("length").alias("n_bytes"), F.sum("n").alias("n_lines"), F.sum("h").alias("hash_sum")
    )


@query(
    "read_by_type",
    """SELECT kind, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total,
         CAST(sum(length(props)) AS BIGINT) AS props_chars
       FROM events, (VALUES ('csv'), ('tsv'), ('jsonl'), ('xml')) AS k(kind) GROUP BY kind, event_type""",
)
def read_by_type(t):
    rows = t.events.select("event_id", "event_type", "value", "props")
    root = fresh_path(t.spark, "formats")
    rows.write.option("header", "true").option("escape", '"').csv(f"{root}/csv")
    rows.write.option("header", "true").option("escape", '"').option("sep", "\t").csv(f"{root}/tsv")
    rows.write.json(f"{root}/jsonl")
    rows.write.option("rowTag", "event").xml(f"{root}/xml")
    out = None
    for kind in ("csv", "tsv", "jsonl", "xml"):
        read = files.read_by_type(t.spark, f"{root}/{kind}", kind, EVENT_FIELDS, row_tag="event")
        one = read.groupBy("event_type").agg(
            F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
            F.sum(F.char_length("props")).alias("props_chars"),
        ).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@query(
    "read_text_objects",
    "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source",
)
def read_text_objects(t):
    root = fresh_path(t.spark, "texts")
    t.documents.select("source", "text").write.partitionBy("source").text(root)
    out = files.read_text_objects(t.spark, [root])
    return out.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(
        F.sum(F.char_length("text")).alias("n_chars")
    )


@query(
    "write_json_objects",
    "SELECT CAST(c_nationkey AS VARCHAR) AS user_id, c_custkey, c_name, c_acctbal FROM customer",
)
def write_json_objects(t):
    root = fresh_path(t.spark, "objects")
    rows = t.customer.select(F.col("c_nationkey").cast("string").alias("user_id"), "c_custkey", "c_name", "c_acctbal")
    files.write_json_objects(rows, root)
    return t.spark.read.schema("user_id string, c_custkey long, c_name string, c_acctbal double").json(root).select(
        "user_id", "c_custkey", "c_name", "c_acctbal"
    )


def messages(t):
    """Change messages made from events: errors delete, signups insert, others update."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    body = F.struct(
        F.struct(
            F.concat(F.lit("g"), F.col("user_id") % 8).alias("calc_graph_ref"),
            (F.col("event_type") == "purchase").alias("is_deleted"), "value",
        ).alias("fullDocument"),
        F.struct(F.struct(F.concat(F.lit("d"), F.col("user_id")).alias("$oid")).alias("_id")).alias("documentKey"),
        kind.alias("operationType"), F.col("event_type").alias("collection"), F.col("event_id").alias("sequence"),
    )
    return t.events.select("event_id", F.to_json(body).alias("data"))


MESSAGE_SQL = """msgs AS (
  SELECT event_id, 'g' || (user_id % 8) AS graph_id, 'd' || user_id AS id, event_type AS collection,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation,
    event_type = 'purchase' AS is_deleted, value FROM events)"""


@query(
    "read_change_feed",
    f"""WITH {MESSAGE_SQL} SELECT graph_id, id, collection, operation, is_deleted, count(*) AS n, count(*) FILTER (FALSE) AS bad
        FROM msgs GROUP BY graph_id, id, collection, operation, is_deleted""",
)
def read_change_feed(t):
    root = fresh_path(t.spark, "feed")
    messages(t).select("data").write.json(root)
    parsed = changes.parse_changes(changes.read_change_feed(t.spark, root))
    return parsed.groupBy("graph_id", "id", "collection", "operation", "is_deleted").agg(
        F.count("*").alias("n"), F.count("error").alias("bad")
    )


@query(
    "bounding_box",
    """SELECT l_returnflag, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_extendedprice) AS min_y,
              max(l_extendedprice) AS max_y FROM lineitem GROUP BY l_returnflag""",
)
def bounding_box(t):
    return profile.bounding_box(t.lineitem, F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"])


@query(
    "bounding_box_embeddings",
    """SELECT label, min(embedding[1]) AS min_x, max(embedding[1]) AS max_x, min(embedding[2]) AS min_y,
              max(embedding[2]) AS max_y FROM embeddings GROUP BY label""",
)
def bounding_box_embeddings(t):
    return profile.bounding_box(t.embeddings, F.col("embedding")[0], F.col("embedding")[1], ["label"])


@query(
    "profile_table",
    """SELECT unnest([0, 1, 2, 3, 4, 5]) AS ordinal,
         unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
         unnest(['int64', 'int64', 'object', 'float64', 'datetime64[ns]', 'object']) AS dtype, count(*) AS num_rows,
         6 AS num_columns FROM orders""",
)
def profile_table(t):
    return profile.profile_table(t.orders)


@query(
    "profile_json",
    """SELECT event_id, 1 AS item_count, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS sample,
              'OBJECT<k: BIGINT>' AS schema, CAST(NULL AS VARCHAR) AS error FROM events""",
)
def profile_json(t):
    found = t.events.select("event_id", profile.profile_json(F.col("props")).alias("p"))
    return found.select("event_id", "p.*")


_LINES = r"""regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"""


@query(
    "profile_text",
    f"""WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents)
    SELECT doc_id, CAST(len(lines) AS INTEGER) AS line_count, array_to_string(lines[1:5], chr(10)) AS preview FROM l""",
)
def profile_text(t):
    found = t.documents.select("doc_id", profile.profile_text(F.col("text")).alias("p"))
    return found.select("doc_id", "p.*")


_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?s)<!\[CDATA\[.*?\]\]>', '', 'g'), '(?s)<\?.*?\?>', '', 'g'), '(?s)<![A-Za-z][^>]*>', '', 'g')"""


@query(
    "profile_xml",
    rf"""WITH g AS (SELECT page_id, regexp_extract_all({_BARE}, '<([A-Za-z_][^\s/>]*)', 1) AS tags FROM pages),
    u AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS at_ FROM g),
    f AS (SELECT page_id, tag, min(at_) AS first_at FROM u GROUP BY page_id, tag),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_at) AS rn FROM f)
    SELECT g.page_id, g.tags[1] AS root_tag, CAST(len(g.tags) AS INTEGER) AS num_elements,
           string_agg(r.tag, ',' ORDER BY r.rn) AS sample_tags
    FROM g JOIN r ON r.page_id = g.page_id AND r.rn <= 10 GROUP BY g.page_id, g.tags""",
)
def profile_xml(t):
    found = t.pages.select("page_id", profile.profile_xml(F.col("html")).alias("p"))
    return found.select("page_id", "p.root_tag", "p.num_elements", F.array_join("p.sample_tags", ",").alias("sample_tags"))


@query(
    "profile_files",
    rf"""WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents)
    SELECT 'd' || doc_id || '.txt' AS file_name, 'text' AS file_type, CAST(len(lines) AS DOUBLE) AS line_count,
           CAST(NULL AS DOUBLE) AS item_count, CAST(NULL AS DOUBLE) AS num_rows, CAST(NULL AS DOUBLE) AS num_columns,
           CAST(NULL AS VARCHAR) AS error FROM l
    UNION ALL SELECT 'e' || event_id || '.json', 'json', NULL, 1, NULL, NULL, NULL FROM events
    UNION ALL SELECT 'e' || event_id || '.csv', 'csv', NULL, NULL, 1, 2, NULL FROM events
    UNION ALL SELECT 'b' || event_id || '.json', NULL, NULL, NULL, NULL, NULL, 'Failed to process file: not JSON' FROM events""",
)
def profile_files(t):
    """Rows of the tables as files of four kinds, one of them broken."""

    def named(df, letter, key, suffix, content):
        path = F.concat(F.lit(letter), F.col(key).cast("string"), F.lit(suffix))
        return df.select(path.alias("path"), content.cast("binary").alias("content"))

    csv = F.concat(F.lit("k,v\n"), F.col("event_type"), F.lit(","), F.col("value").cast("string"), F.lit("\n"))
    rows = named(t.documents, "d", "doc_id", ".txt", F.col("text"))
    rows = rows.unionAll(named(t.events, "e", "event_id", ".json", F.col("props")))
    rows = rows.unionAll(named(t.events, "e", "event_id", ".csv", csv))
    rows = rows.unionAll(named(t.events, "b", "event_id", ".json", F.concat(F.lit("{"), F.col("props"))))
    out = profile.profile_files(rows)
    counts = [F.col(c).cast("double").alias(c) for c in ("line_count", "item_count", "num_rows", "num_columns")]
    return out.select("file_name", "file_type", *counts, "error")


@query(
    "profile_image_headers",
    """SELECT o_orderkey || '.' || kind AS file_name, 'image' AS file_type, format, mode,
           o_custkey % 60000 + 1 AS width, o_orderkey % 60000 + 1 AS height
    FROM orders CROSS JOIN (VALUES ('png', 'PNG', 'RGBA'), ('gif', 'GIF', 'P'), ('bmp', 'BMP', 'RGB'), ('jpg', 'JPEG', 'L'))
         AS k(kind, format, mode)""",
)
def profile_image_headers(t):
    """Image headers whose sizes come from orders; the JPEG has two segments before its frame."""
    sides = {"w": F.col("o_custkey") % 60000 + 1, "h": F.col("o_orderkey") % 60000 + 1}
    big = {n: F.lpad(F.hex(c), 8, "0") for n, c in sides.items()}
    small = {n: F.concat(*[F.substring(c, at, 2) for at in (7, 5, 3, 1)]) for n, c in big.items()}
    last = {n: F.substring(c, 5, 4) for n, c in big.items()}
    texts = {
        "png": ["89504E470D0A1A0A0000000D49484452", big["w"], big["h"], "0806000000"],
        "gif": ["474946383961", F.substring(small["w"], 1, 4), F.substring(small["h"], 1, 4), "F70000"],
        "bmp": ["424D", "00" * 12, "28000000", small["w"], small["h"], "01001800"],
        "jpg": ["FFD8", "FFE00010" + "00" * 14, "FFDB0043" + "01" * 65, "FFC0000B08", last["h"], last["w"], "01011100"],
    }

    def content(parts):
        return F.unhex(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))

    made = [
        F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit("." + kind)).alias("path"), content(parts).alias("content"))
        for kind, parts in texts.items()
    ]
    out = profile.profile_files(t.orders.select(F.inline(F.array(*made))))
    return out.select("file_name", "file_type", "format", "mode", "width", "height")
