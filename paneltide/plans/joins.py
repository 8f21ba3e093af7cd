"""Aligning, overlaying, merging, locking; reports and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import graph, joins, reports
from paneltide.plans import panels as p
from paneltide.plans.reads import _DOCS_SQL, document_graph
from paneltide.plans.registry import query

KEYS = ["full_name", "attribute_name", "clone_num", "tr_start", "tr_end"]


@query(
    "align_to_grid",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID}
    SELECT g.full_name, g.clone_num, g.tr_start, g.tr_end, l.value, l.version
    FROM event_grid g LEFT JOIN event_latest l USING (full_name, attribute_name, clone_num, tr_start, tr_end)""",
)
def align_to_grid(t):
    out = joins.align_to_grid(p.event_latest(t).select(*KEYS, "value", "version"), p.event_grid(t))
    return out.select("full_name", "clone_num", "tr_start", "tr_end", "value", "version")


@query(
    "align_to_grid_orders",
    f"""WITH {p.ORDER_LATEST}, {p.ORDER_GRID}
    SELECT g.full_name, g.clone_num, g.tr_start, l.value, CAST(l.order_id AS DOUBLE) AS order_id
    FROM order_grid g LEFT JOIN order_latest l USING (full_name, attribute_name, clone_num, tr_start, tr_end)""",
)
def align_to_grid_orders(t):
    out = joins.align_to_grid(p.order_latest(t).select(*KEYS, "value", "order_id"), p.order_grid(t))
    return out.select("full_name", "clone_num", "tr_start", "value", F.col("order_id").cast("double").alias("order_id"))


_FRESH_SQL = """
fresh AS (
  SELECT full_name, clone_num, tr_start, tr_end,
         max(CASE WHEN value > 400000 THEN NULL ELSE value END) AS value, count(*) AS n
  FROM order_blocks WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  GROUP BY full_name, clone_num, tr_start, tr_end)"""


@query(
    "overlay",
    f"""WITH {p.ORDER_LATEST}, {_FRESH_SQL}
    SELECT coalesce(f.full_name, l.full_name) AS full_name, coalesce(f.clone_num, l.clone_num) AS clone_num,
           coalesce(f.tr_start, l.tr_start) AS tr_start,
           CASE WHEN f.full_name IS NOT NULL THEN f.value ELSE l.value END AS value
    FROM fresh f FULL JOIN order_latest l
      ON f.full_name = l.full_name AND f.clone_num = l.clone_num AND f.tr_start = l.tr_start""",
)
def overlay(t):
    keys = ["full_name", "clone_num", "tr_start", "tr_end"]
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    fresh = p.order_blocks(t).join(done, "order_id", "left_semi").groupBy(*keys).agg(
        F.max(F.when(F.col("value") <= 400000, F.col("value"))).alias("value")
    )
    out = joins.overlay(fresh, p.order_latest(t).select(*keys, "value"), keys)
    return out.select("full_name", "clone_num", "tr_start", "value")


_DEPS = [("purchase", "click"), ("purchase", "view"), ("click", "view")]


@query(
    "gather_inputs",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID},
    deps(full_name, input_full_name) AS (VALUES ('purchase', 'click'), ('purchase', 'view'), ('click', 'view'))
    SELECT g.full_name, g.clone_num, g.tr_start, d.input_full_name || '.data' AS input, l.value
    FROM event_grid g JOIN deps d USING (full_name)
    LEFT JOIN event_latest l ON l.full_name = d.input_full_name AND l.clone_num = g.clone_num
      AND l.tr_start = g.tr_start AND l.tr_end = g.tr_end""",
)
def gather_inputs(t):
    deps = t.spark.createDataFrame(
        [(a, "data", b, "data") for a, b in _DEPS],
        "full_name string, attribute_name string, input_full_name string, input_attribute_name string",
    )
    out = joins.gather_inputs(p.event_grid(t), deps, p.event_latest(t))
    return out.select("full_name", "clone_num", "tr_start", F.explode("inputs").alias("input", "value"))


_EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


@query(
    "merge_keyed",
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, rn AS occurrence, "
    + ", ".join(f"max(value) FILTER (event_type = '{k}') AS value_{i}" for i, k in enumerate(_EVENT_TYPES))
    + " FROM n GROUP BY user_id, rn",
)
def merge_keyed(t):
    parts = [t.events.where(F.col("event_type") == k) for k in _EVENT_TYPES]
    return joins.merge_keyed(parts, ["user_id"], ["ts", "event_id"])


_GROUPS = [(0, ["click", "view"]), (1, ["view", "purchase", "signup"]), (2, ["error"])]


@query(
    "merge_with_groups",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID},
    g(group_idx, id) AS (VALUES (0, 'click'), (0, 'view'), (1, 'view'), (1, 'purchase'), (1, 'signup'), (2, 'error')),
    k AS (SELECT DISTINCT clone_num, tr_start FROM event_grid)
    SELECT k.clone_num, k.tr_start, g.group_idx, g.id, l.value
    FROM k CROSS JOIN g LEFT JOIN event_latest l
      ON l.clone_num = k.clone_num AND l.tr_start = k.tr_start AND l.full_name = g.id""",
)
def merge_with_groups(t):
    groups = t.spark.createDataFrame(_GROUPS, "group_idx int, ids array<string>")
    contexts = p.event_grid(t).select("clone_num", "tr_start").distinct()
    keys = contexts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(_GROUPS) - 1))).alias("group_idx"))
    out = joins.merge_with_groups(keys, p.event_latest(t), groups, ["clone_num", "tr_start"], id_column="full_name")
    return out.select("clone_num", "tr_start", "group_idx", F.explode("values").alias("id", "value"))


@query(
    "zip_strict",
    """SELECT a.pos AS position, a.c_custkey AS by_key, b.c_custkey AS by_balance
    FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) a
    JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer) b USING (pos)""",
)
def zip_strict(t):
    out = joins.zip_strict(
        [t.customer.select("c_custkey"), t.customer.select("c_acctbal", "c_custkey")],
        [["c_custkey"], ["c_acctbal", "c_custkey"]],
    )
    return out.select("position", F.col("item_0.c_custkey").alias("by_key"), F.col("item_1.c_custkey").alias("by_balance"))


@query(
    "within_range",
    f"""WITH {p.ORDER_BLOCKS}, r AS (
      SELECT full_name, min(tr_start) + INTERVAL 360 DAY AS lo, max(tr_end) - INTERVAL 360 DAY AS hi
      FROM order_blocks GROUP BY full_name)
    SELECT full_name, order_id, tr_start, tr_end FROM order_blocks JOIN r USING (full_name)
    WHERE tr_start >= lo AND tr_end <= hi""",
)
def within_range(t):
    blocks = p.order_blocks(t)
    ranges = blocks.groupBy("full_name").agg(
        (F.min("tr_start") + F.expr("INTERVAL 360 DAYS")).alias("lo"), (F.max("tr_end") - F.expr("INTERVAL 360 DAYS")).alias("hi")
    )
    return joins.within_range(blocks, ranges, ["full_name"]).select("full_name", "order_id", "tr_start", "tr_end")


@query(
    "within_ranges_open",
    f"""WITH {p.ORDER_BLOCKS}, r AS (
      SELECT DISTINCT full_name, tr_start AS lo, tr_start + INTERVAL 200 DAY AS hi FROM order_blocks WHERE month(tr_start) = 3
      UNION ALL SELECT DISTINCT full_name, TIMESTAMP '0001-01-01', TIMESTAMP '9999-12-31' FROM order_blocks WHERE clone_num = 1)
    SELECT full_name, order_id, tr_start, tr_end, CAST(lo AS VARCHAR) AS lo FROM order_blocks JOIN r USING (full_name)
    WHERE tr_start >= lo AND tr_end <= hi""",
)
def within_ranges_open(t):
    """Several ranges per key, one of them open at both ends, met in dyadic cells."""
    blocks = p.order_blocks(t)
    spring = blocks.where(F.month("tr_start") == 3).select(
        "full_name", F.col("tr_start").alias("lo"), (F.col("tr_start") + F.expr("INTERVAL 200 DAYS")).alias("hi")
    )
    always = blocks.where("clone_num = 1").select(
        "full_name", F.lit("0001-01-01").cast("timestamp").alias("lo"), F.lit("9999-12-31").cast("timestamp").alias("hi")
    )
    ranges = spring.distinct().unionByName(always.distinct())
    out = joins.within_range(blocks, ranges, ["full_name"], many=True)
    return out.select("full_name", "order_id", "tr_start", "tr_end", F.date_format("lo", "yyyy-MM-dd HH:mm:ss").alias("lo"))


@query(
    "needed_inputs",
    f"""WITH {p.ORDER_BLOCKS}
    SELECT full_name, clone_num, tr_start, order_id, value FROM order_blocks b
    WHERE EXISTS (SELECT 1 FROM customer WHERE 'c' || c_custkey = b.full_name AND c_acctbal > 0)
      AND NOT EXISTS (SELECT 1 FROM customer WHERE 'c' || c_custkey = b.full_name AND c_mktsegment = 'MACHINERY')""",
)
def needed_inputs(t):
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    deps = t.customer.where("c_acctbal > 0").select(
        name.alias("input_full_name"), F.lit("data").alias("input_attribute_name")
    )
    running = t.customer.where("c_mktsegment = 'MACHINERY'").select(name.alias("full_name"))
    out = joins.needed_inputs(p.order_blocks(t), deps, running)
    return out.select("full_name", "clone_num", "tr_start", "order_id", "value")


_LOCKS_SQL = f"""WITH {p.ORDER_LATEST},
locks AS (SELECT DISTINCT clone_num, tr_start, tr_end FROM order_latest WHERE clone_num = 1),
held AS (
  SELECT full_name, clone_num, tr_start, value FROM (
    SELECT *, row_number() OVER (PARTITION BY full_name, clone_num, tr_start ORDER BY version, order_id DESC) AS rn
    FROM order_blocks WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) WHERE rn = 1)"""


def _locks(t):
    latest = p.order_latest(t)
    return latest, latest.where("clone_num = 1").select("clone_num", "tr_start", "tr_end").distinct()


@query(
    "apply_locks",
    _LOCKS_SQL + """
    SELECT c.full_name, c.clone_num, c.tr_start, CASE WHEN k.clone_num IS NULL THEN c.value ELSE h.value END AS value,
           TIMESTAMP '2024-06-01' AS version, k.clone_num IS NOT NULL AS lock_value
    FROM order_latest c LEFT JOIN locks k USING (clone_num, tr_start, tr_end)
    LEFT JOIN held h ON h.full_name = c.full_name AND h.clone_num = c.clone_num AND h.tr_start = c.tr_start""",
)
def apply_locks(t):
    latest, locks = _locks(t)
    kept = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id"))
    stored = p.order_blocks(t).join(kept, "order_id", "left_semi")
    first = stored.groupBy(*KEYS).agg(
        F.max_by(F.struct("value"), F.struct(-F.unix_micros("version"), F.col("order_id")))["value"].alias("value")
    ).withColumn("lock_value", F.lit(True))
    out = joins.apply_locks(latest, locks, first, F.lit("2024-06-01").cast("timestamp"))
    return out.select("full_name", "clone_num", "tr_start", "value", "version", "lock_value")


@query(
    "unlocked",
    _LOCKS_SQL + """ SELECT full_name, clone_num, tr_start, tr_end FROM order_latest c
    WHERE NOT EXISTS (SELECT 1 FROM locks k WHERE k.clone_num = c.clone_num AND k.tr_start = c.tr_start AND k.tr_end = c.tr_end)""",
)
def unlocked(t):
    latest, locks = _locks(t)
    return joins.unlocked(latest, locks).select("full_name", "clone_num", "tr_start", "tr_end")


# --- reports --------------------------------------------------------------------------


@query(
    "run_report",
    f"""WITH {p.EVENT_BLOCKS}, o AS (
      SELECT b.full_name, b.clone_num, b.tr_start, b.event_id,
             trim(CASE WHEN b.value > 100 THEN '' ELSE ' ' || e.props || ' ' END) AS log
      FROM event_blocks b JOIN events e USING (event_id)),
    ends AS (
      SELECT full_name, clone_num, tr_start, min(event_id) FILTER (log <> '') AS a, max(event_id) FILTER (log <> '') AS z
      FROM o GROUP BY full_name, clone_num, tr_start),
    lines AS (
      SELECT full_name, CASE WHEN event_id = a THEN 'While running ' || tr_start::VARCHAR || ', ' || clone_num || ':' || chr(10)
                        ELSE '' END || log AS line,
             row_number() OVER (PARTITION BY full_name ORDER BY tr_start, clone_num, event_id) AS rn
      FROM o JOIN ends USING (full_name, clone_num, tr_start) WHERE event_id BETWEEN a AND z)
    SELECT full_name, CAST((rn - 1) // 200 AS BIGINT) AS segment, full_name = 'error' AS failed,
           string_agg(line, chr(10) ORDER BY rn) AS combined_output, TIMESTAMP '2024-06-01' AS version
    FROM lines GROUP BY full_name, (rn - 1) // 200""",
)
def run_report(t):
    outputs = p.event_blocks(t).join(t.events.select("event_id", "props"), "event_id").select(
        "full_name", "clone_num", "tr_start", "event_id", (F.col("full_name") == "error").alias("failed"),
        F.when(F.col("value") > 100, F.lit("")).otherwise(F.concat(F.lit(" "), "props", F.lit(" "))).alias("combined_output"),
    )
    return reports.run_report(
        outputs, ["full_name"], ["tr_start", "clone_num"], "event_id", F.lit("2024-06-01").cast("timestamp"),
        lines_per_segment=200,
    )


def _kind_sql(kind: str, log: str) -> str:
    """Lines of one log, numbered per name."""
    return f"""{kind}_o AS (
      SELECT b.full_name, b.clone_num, b.tr_start, b.event_id, trim({log}) AS log
      FROM event_blocks b JOIN events e USING (event_id)),
    {kind}_ends AS (
      SELECT full_name, clone_num, tr_start, min(event_id) FILTER (log <> '') AS a, max(event_id) FILTER (log <> '') AS z
      FROM {kind}_o GROUP BY full_name, clone_num, tr_start),
    {kind}_lines AS (
      SELECT full_name, CASE WHEN event_id = a THEN 'While running ' || tr_start::VARCHAR || ', ' || clone_num || ':' || chr(10)
                        ELSE '' END || log AS line,
             row_number() OVER (PARTITION BY full_name ORDER BY tr_start, clone_num, event_id) AS rn
      FROM {kind}_o JOIN {kind}_ends USING (full_name, clone_num, tr_start) WHERE event_id BETWEEN a AND z),
    {kind}_text AS (
      SELECT full_name, CAST((rn - 1) // 200 AS BIGINT) AS segment, string_agg(line, chr(10) ORDER BY rn) AS {kind}
      FROM {kind}_lines GROUP BY full_name, (rn - 1) // 200)"""


@query(
    "run_report_logs",
    f"""WITH {p.EVENT_BLOCKS}, {_kind_sql("stdout", "CASE WHEN b.value > 100 THEN '' ELSE e.props END")},
    {_kind_sql("stderr", "CASE WHEN b.value > 20 THEN '' ELSE 'low ' || b.event_id END")}
    SELECT full_name, segment, full_name = 'error' AS failed, coalesce(stdout, '') AS stdout, coalesce(stderr, '') AS stderr
    FROM stdout_text FULL JOIN stderr_text USING (full_name, segment)""",
)
def run_report_logs(t):
    """Two logs in one pass, each in segments of its own."""
    outputs = p.event_blocks(t).join(t.events.select("event_id", "props"), "event_id").select(
        "full_name", "clone_num", "tr_start", "event_id", (F.col("full_name") == "error").alias("failed"),
        F.when(F.col("value") > 100, F.lit("")).otherwise(F.col("props")).alias("stdout"),
        F.when(F.col("value") > 20, F.lit("")).otherwise(F.concat(F.lit("low "), F.col("event_id").cast("string"))).alias("stderr"),
    )
    out = reports.run_report(
        outputs, ["full_name"], ["tr_start", "clone_num"], "event_id", F.lit("2024-06-01").cast("timestamp"),
        logs=("stdout", "stderr"), lines_per_segment=200,
    )
    return out.drop("version")


@query(
    "failed_attributes",
    """SELECT 'u' || user_id AS full_name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS failed_attributes
       FROM events WHERE value > 150 GROUP BY user_id""",
)
def failed_attributes(t):
    outputs = t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("full_name"),
        F.col("event_type").alias("attribute_name"), (F.col("value") > 150).alias("failed"),
    )
    out = reports.failed_attributes(outputs)
    return out.select("full_name", F.array_join("failed_attributes", ",").alias("failed_attributes"))


# --- graphs ---------------------------------------------------------------------------


@query(
    "propagate_failures",
    """WITH RECURSIVE edges AS (
      SELECT 'n' || n_nationkey AS doc_id, 'r' || n_regionkey AS input_doc_id, 1 AS ord FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1 FROM customer
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 1 FROM orders),
    failed(doc_id, attribute_name) AS (
      SELECT 'r' || r_regionkey, 'data' FROM region WHERE r_name = 'ASIA'
      UNION ALL SELECT 'c' || c_custkey, 'data' FROM customer WHERE c_acctbal < 500
      UNION ALL SELECT 'c' || c_custkey, 'notes' FROM customer WHERE c_acctbal < 100),
    walk(doc_id, attribute_name, level) AS (
      SELECT doc_id, attribute_name, 0 FROM failed
      UNION
      SELECT e.doc_id, 'data', w.level + 1 FROM walk w JOIN edges e ON e.input_doc_id = w.doc_id WHERE w.level < 10),
    seen AS (SELECT doc_id, attribute_name, min(level) AS level FROM walk GROUP BY doc_id, attribute_name),
    lists AS (SELECT doc_id, string_agg('''' || attribute_name || '''', ', ' ORDER BY attribute_name) AS atts
              FROM seen GROUP BY doc_id)
    SELECT s.doc_id, s.attribute_name, s.level,
      CASE WHEN s.level > 0 THEN 'Upstream failure from ' || e.input_doc_id || ': [' || l.atts || ']' END AS message
    FROM seen s LEFT JOIN edges e ON e.doc_id = s.doc_id AND s.level > 0
    LEFT JOIN lists l ON l.doc_id = e.input_doc_id""",
)
def propagate_failures(t):
    _, _, edges = document_graph(t)
    orders = t.orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit("data").alias("attribute_name"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("input_doc_id"),
    )
    edges = edges.select("doc_id", "attribute_name", "input_doc_id").unionAll(orders).withColumn("ord", F.lit(1))
    cust = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc_id")
    failed = (
        t.region.where("r_name = 'ASIA'").select(
            F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.lit("data").alias("attribute_name"))
        .unionAll(t.customer.where("c_acctbal < 500").select(cust, F.lit("data").alias("attribute_name")))
        .unionAll(t.customer.where("c_acctbal < 100").select(cust, F.lit("notes").alias("attribute_name")))
    )
    return graph.propagate_failures(edges, failed).select("doc_id", "attribute_name", "level", "message")


@query(
    "hierarchy_levels",
    """WITH RECURSIVE edges(parent, child, ord) AS (
      SELECT 'world', 'r' || r_regionkey, CAST(r_regionkey AS BIGINT) FROM region
      UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, CAST(n_nationkey AS BIGINT) FROM nation
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer),
    walk(node, level, path) AS (
      SELECT 'world', 0, CAST([] AS BIGINT[])
      UNION ALL
      SELECT e.child, w.level + 1, list_append(w.path, e.ord) FROM walk w JOIN edges e ON e.parent = w.node)
    SELECT node, level, rank, rank * 100 AS x, CAST(level * 100 AS INTEGER) AS y FROM (
      SELECT node, level, row_number() OVER (PARTITION BY level ORDER BY path) - 1 AS rank FROM walk)""",
)
def hierarchy_levels(t):
    def link(df, parent, child, ord_):
        return df.select(parent.alias("parent"), child.alias("child"), F.col(ord_).cast("long").alias("ord"))

    def name(letter, key):
        return F.concat(F.lit(letter), F.col(key).cast("string"))

    edges = link(t.region, F.lit("world"), name("r", "r_regionkey"), "r_regionkey")
    edges = edges.unionAll(link(t.nation, name("r", "n_regionkey"), name("n", "n_nationkey"), "n_nationkey"))
    edges = edges.unionAll(link(t.customer, name("n", "c_nationkey"), name("c", "c_custkey"), "c_custkey"))
    return graph.hierarchy_levels(edges, "world")


@query(
    "hierarchy_levels_shared",
    """WITH RECURSIVE edges(parent, child, ord) AS (
      SELECT 'world', 'r' || r_regionkey, CAST(r_regionkey AS BIGINT) FROM region
      UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey FROM nation
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 2 * s_suppkey FROM supplier
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 2 * c_custkey + 1 FROM customer
      UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders
      UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, l_partkey FROM lineitem
      UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, l_partkey FROM lineitem),
    walk(node, path) AS (
      SELECT 'world', CAST([] AS BIGINT[])
      UNION ALL
      SELECT e.child, list_append(w.path, e.ord) FROM walk w JOIN edges e ON e.parent = w.node),
    visits AS (SELECT node, min(path) AS path FROM walk GROUP BY node)
    SELECT node, CAST(len(path) AS INTEGER) AS level, row_number() OVER (PARTITION BY len(path) ORDER BY path) - 1 AS rank
    FROM visits""",
)
def hierarchy_levels_shared(t):
    """Parts stand below the orders and the suppliers that hold them; the first visit counts."""

    def link(df, above, up, below, down, ord_):
        def name(letter, key):
            return F.concat(F.lit(letter), F.col(key).cast("string"))

        return df.select(name(above, up).alias("parent"), name(below, down).alias("child"), ord_.cast("long").alias("ord"))

    edges = t.region.select(
        F.lit("world").alias("parent"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"),
        F.col("r_regionkey").cast("long").alias("ord"),
    )
    for part in (
        link(t.nation, "r", "n_regionkey", "n", "n_nationkey", F.col("n_nationkey")),
        link(t.supplier, "n", "s_nationkey", "s", "s_suppkey", F.col("s_suppkey") * 2),
        link(t.customer, "n", "c_nationkey", "c", "c_custkey", F.col("c_custkey") * 2 + 1),
        link(t.orders, "c", "o_custkey", "o", "o_orderkey", F.col("o_orderkey")),
        link(t.lineitem, "o", "l_orderkey", "p", "l_partkey", F.col("l_partkey")),
        link(t.lineitem, "s", "l_suppkey", "p", "l_partkey", F.col("l_partkey")),
    ):
        edges = edges.unionAll(part)
    return graph.hierarchy_levels(edges, "world").select("node", "level", "rank")
