"""Categories, feature vectors, lag panels, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import features
from paneltide.plans import panels as p
from paneltide.plans.registry import query


def _customer_values(t):
    note = F.when(F.col("c_acctbal") >= 0, F.lit("ok"))
    return t.customer.select(
        "c_custkey",
        F.struct("c_name", "c_mktsegment", note.alias("note"), F.col("c_nationkey"), F.array("c_acctbal", F.lit(1.5)).alias("nums")).alias("value"),
    )


_CATEGORIES = """cats AS (
  SELECT category FROM (
    SELECT c_name AS category FROM customer UNION SELECT c_mktsegment FROM customer
    UNION SELECT CASE WHEN c_acctbal >= 0 THEN 'ok' END FROM customer
    UNION SELECT unnest(['c_name', 'c_mktsegment', 'note', 'c_nationkey', 'nums']))),
ids AS (SELECT category, row_number() OVER (ORDER BY coalesce(category, 'None'), category IS NULL) AS category_id FROM cats)"""


@query(
    "build_categories",
    f"WITH {_CATEGORIES} SELECT category, category_id FROM ids UNION ALL SELECT '__UNK__', 0",
)
def build_categories(t):
    return features.build_categories(_customer_values(t), ["value"])


def _id(expression: str) -> str:
    return f"(SELECT category_id FROM ids WHERE category IS NOT DISTINCT FROM {expression})"


_VECTOR = f"""WITH {_CATEGORIES},
v AS (
  SELECT c_custkey, c_acctbal, c_nationkey, a.category_id AS name_id, b.category_id AS seg_id, n.category_id AS note_id,
    k1.category_id AS k1, k2.category_id AS k2, k3.category_id AS k3, k4.category_id AS k4, k5.category_id AS k5
  FROM customer
  JOIN ids a ON a.category = c_name JOIN ids b ON b.category = c_mktsegment
  JOIN ids n ON n.category IS NOT DISTINCT FROM CASE WHEN c_acctbal >= 0 THEN 'ok' END
  JOIN ids k1 ON k1.category = 'c_name' JOIN ids k2 ON k2.category = 'c_mktsegment' JOIN ids k3 ON k3.category = 'note'
  JOIN ids k4 ON k4.category = 'c_nationkey' JOIN ids k5 ON k5.category = 'nums')"""


@query(
    "flatten_features",
    _VECTOR + """ SELECT c_custkey, CAST(pos AS INTEGER) AS pos, x FROM (
      SELECT c_custkey, [k1, name_id, k2, seg_id, k3, note_id, k4, c_nationkey, k5, c_acctbal, 1.5]::DOUBLE[] AS f FROM v),
      LATERAL (SELECT unnest(f) AS x, generate_subscripts(f, 1) - 1 AS pos)""",
)
def flatten_features(t):
    values = _customer_values(t)
    cats = features.build_categories(values, ["value"])
    flat = features.flatten_features(values, ["c_custkey"], "value", cats)
    return flat.select("c_custkey", F.posexplode("features").alias("pos", "x"))


@query(
    "unflatten_features",
    """SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN 'ok' END AS note, c_nationkey,
              c_acctbal AS first_num FROM customer""",
)
def unflatten_features(t):
    values = _customer_values(t)
    cats = features.build_categories(values, ["value"])
    flat = features.flatten_features(values, ["c_custkey"], "value", cats)
    back = features.unflatten_features(values.join(flat, "c_custkey"), ["c_custkey"], "features", "value", cats)
    return back.select("c_custkey", "value.c_name", "value.c_mktsegment", "value.note", "value.c_nationkey",
                       F.col("value.nums")[0].alias("first_num"))


@query(
    "lag_panel",
    """SELECT event_id, event_type, row_number() OVER w AS n_seen,
         array_to_string(list(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id
                         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
)
def lag_panel(t):
    series = t.events.select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = features.lag_panel(series, ["event_type"], "event_id", "cents", window_size=5)
    return out.select("event_id", "event_type", "n_seen", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("forecast")
def forecast(t):
    """Next monthly order total per customer from a regression on its last three."""
    monthly = p.order_latest(t).groupBy("full_name", "tr_start").agg(F.sum("value").alias("value"))
    panel = features.lag_panel(monthly, ["full_name"], "tr_start", "value", window_size=4)
    return features.forecast(panel, ["full_name"], 3)


@query(
    "forecast_predictor",
    f"""WITH {p.ORDER_LATEST}, m AS (
      SELECT full_name, tr_start, sum(CAST(value AS DECIMAL(18, 2))) AS value FROM order_latest GROUP BY full_name, tr_start),
    r AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY tr_start DESC) AS rn FROM m)
    SELECT full_name, CAST(max(value) AS DOUBLE) AS prediction, 'predictor' AS method FROM r WHERE rn <= 3 GROUP BY full_name""",
)
def forecast_predictor(t):
    """The same with a caller's predictor: the largest of the last three."""
    monthly = p.order_latest(t).groupBy("full_name", "tr_start").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")
    )
    panel = features.lag_panel(monthly, ["full_name"], "tr_start", "value", window_size=4)
    return features.forecast(panel, ["full_name"], 3, predictor=max)


def _nested_series(t):
    """Per customer and month: a struct of a text and a number, and as input the number of orders."""
    monthly = p.order_latest(t).groupBy("full_name", "tr_start").agg(
        F.max("clone_num").alias("top"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n")
    )
    label = F.when(F.col("top") > 2, F.lit("late")).otherwise(F.lit("early"))
    own = monthly.select("full_name", "tr_start", F.struct(label.alias("label"), "total").alias("value"))
    return own, monthly.select("full_name", "tr_start", F.col("n").alias("value"))


_NESTED_SQL = f"""{p.ORDER_LATEST}, m AS (
      SELECT full_name, tr_start, CASE WHEN max(clone_num) > 2 THEN 'late' ELSE 'early' END AS label,
        CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n FROM order_latest GROUP BY full_name, tr_start),
    r AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY tr_start DESC) AS rn,
        lag(total) OVER (PARTITION BY full_name ORDER BY tr_start) AS prior_total FROM m)"""


@query(
    "forecast_nested_predictor",
    f"""WITH {_NESTED_SQL} SELECT full_name, max(CASE WHEN rn = 1 THEN label END) AS label,
      max(total) + max(CASE WHEN rn = 1 THEN n END) AS total, 'predictor' AS method FROM r WHERE rn <= 3 GROUP BY full_name""",
)
def forecast_nested_predictor(t):
    """A struct's next value by a caller's function of three ranges of own and input vectors."""
    own, orders = _nested_series(t)

    def next_value(vectors):
        # A vector: name, label, name, total of the own value; then the input.
        *own_part, n = vectors[-1]
        return [*own_part[:3], max(v[3] for v in vectors) + n]

    out = features.forecast_nested(own, {"orders": orders}, ["full_name"], "tr_start", 3, predictor=next_value)
    return out.select("full_name", "prediction.label", "prediction.total", "method")


@query(
    "forecast_nested",
    f"""WITH {_NESTED_SQL}, fit AS (SELECT regr_slope(total, prior_total) AS s, regr_intercept(total, prior_total) AS i FROM r)
    SELECT full_name, round(s * total + i, 2) AS total, 'regression' AS method FROM r, fit WHERE rn = 1""",
)
def forecast_nested(t):
    """Regression of a struct's next value on its last one: all fields at once, one matrix."""
    own, _ = _nested_series(t)
    numbers = own.select("full_name", "tr_start", F.struct("value.total").alias("value"))
    out = features.forecast_nested(numbers, {}, ["full_name"], "tr_start", 1)
    return out.select("full_name", F.round("prediction.total", 2).alias("total"), "method")
