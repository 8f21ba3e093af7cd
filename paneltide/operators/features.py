"""Category ids, flat feature vectors, lag panels and forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from paneltide.functions import dates
from paneltide.operators.ordered import global_position, rank_in_group
from paneltide.session import cut_lineage

# The reserved category and the default history length.
UNKNOWN = "__UNK__"
WINDOW = 100

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_LEAF = "array<struct<num:double,cat:string,is_cat:boolean>>"


def _cat(c: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("double").alias("num"), c.cast("string").alias("cat"), F.lit(True).alias("is_cat")))


def _num(c: Column) -> Column:
    return F.array(F.struct(c.cast("double").alias("num"), F.lit(None).cast("string").alias("cat"), F.lit(False).alias("is_cat")))


def leaves(c: Column, dtype: T.DataType) -> Column:
    """All scalars of a value in walk order; keys come before their values."""
    if isinstance(dtype, T.StructType):
        parts = [p for f in dtype for p in (_cat(F.lit(f.name)), leaves(c[f.name], f.dataType))]
        out = F.concat(*parts) if parts else F.array().cast(_LEAF)
    elif isinstance(dtype, T.ArrayType):
        out = F.flatten(F.transform(c, lambda x: leaves(x, dtype.elementType)))
    elif isinstance(dtype, T.MapType):
        out = F.flatten(
            F.transform(
                F.map_entries(c), lambda e: F.concat(leaves(e["key"], dtype.keyType), leaves(e["value"], dtype.valueType))
            )
        )
    elif isinstance(dtype, T.StringType):
        return _cat(c)
    elif isinstance(dtype, T.DateType):
        out = _num(F.unix_date(c) * F.lit(86_400.0))
    elif isinstance(dtype, _TIMES):
        out = _num(dates.to_epoch_seconds(c))
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        out = _num(c)
    else:
        raise TypeError(f"Unsupported type during flatten: {dtype.simpleString()}")
    # A missing value is a category of its own.
    return F.when(c.isNull(), _cat(F.lit(None))).otherwise(out)


def build_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct strings and NULL at any depth, numbered from 1 by their text; 0 is unknown.

    Distinct before sorting; the numbering is a distributed sort, so the category list
    may be larger than any one machine.  NULL sorts as ``None``.
    """
    return shared_categories([(df, name) for name in columns])


def shared_categories(values: list[tuple[DataFrame, str]]) -> DataFrame:
    """``build_categories`` over columns of several tables."""
    found = None
    for df, name in values:
        cats = F.filter(leaves(F.col(name), df.schema[name].dataType), lambda x: x["is_cat"])
        one = df.select(F.explode(F.transform(cats, lambda x: x["cat"])).alias("category"))
        found = one if found is None else found.unionAll(one)
    distinct = found.distinct().where(~F.col("category").eqNullSafe(F.lit(UNKNOWN)))
    order = [F.coalesce("category", F.lit("None")), F.col("category").isNull()]
    numbered = global_position(distinct, order, "__pos").select("category", (F.col("__pos") + 1).alias("category_id"))
    reserved = values[0][0].sparkSession.range(1).select(F.lit(UNKNOWN).alias("category"), F.lit(0).cast("long").alias("category_id"))
    return numbered.unionByName(reserved)


def _field_names(dtype: T.DataType) -> set[str]:
    if isinstance(dtype, T.StructType):
        return {f.name for f in dtype}.union(*[_field_names(f.dataType) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return _field_names(dtype.elementType)
    return _field_names(dtype.keyType) | _field_names(dtype.valueType) if isinstance(dtype, T.MapType) else set()


def flatten_features(df: DataFrame, keys: list[str], value: str, categories: DataFrame) -> DataFrame:
    """Values as flat numeric vectors; an empty list, map or struct is an empty vector.

    Names of fields and NULL are the same for all rows: their numbers are read once, at most
    one per field of the type, and stand in the expression.  Other texts become rows, pick up
    their number by a join (the category table may be any size, a frequent category is a
    skewed join key) and return to their places.
    """
    dtype = df.schema[value].dataType
    names = sorted(_field_names(dtype))
    known = categories.where(F.col("category").isNull() | F.col("category").isin(names)).collect()
    fixed = {r["category"]: float(r["category_id"]) for r in known}
    numbers = F.create_map(*[x for k, v in fixed.items() if k is not None for x in (F.lit(k), F.lit(v))]) if len(fixed) > (None in fixed) else None
    null_id = F.lit(fixed.get(None, 0.0))
    placed = df.select(*keys, leaves(F.col(value), dtype).alias("__leaves"))

    def number(leaf: Column) -> Column:
        looked = F.lit(None).cast("double") if numbers is None else F.try_element_at(numbers, leaf["cat"])
        return F.when(~leaf["is_cat"], leaf["num"]).when(leaf["cat"].isNull(), null_id).otherwise(looked)

    texts = F.filter(
        F.transform("__leaves", lambda leaf, i: F.when(leaf["is_cat"] & number(leaf).isNull(), F.struct(i.alias("pos"), leaf["cat"].alias("cat")))),
        lambda e: e.isNotNull(),
    )
    placed = placed.select(*keys, F.transform("__leaves", number).alias("__numbers"), F.transform("__leaves", lambda leaf: leaf["is_cat"]).alias("__cats"), texts.alias("__texts"))
    each = placed.select(*keys, "__numbers", "__cats", F.explode_outer("__texts").alias("__text"))
    ids = categories.where(F.col("category").isNotNull()).select(F.col("category").alias("__category"), F.col("category_id").cast("double").alias("__id"))
    joined = each.join(ids, F.col("__text.cat") == F.col("__category"), "left")
    place = F.when(F.col("__text").isNotNull(), F.struct(F.col("__text.pos").alias("pos"), F.coalesce("__id", F.lit(0.0)).alias("id")))
    grouped = joined.groupBy(*keys).agg(
        F.any_value("__numbers").alias("__numbers"), F.any_value("__cats").alias("__cats"), F.map_from_entries(F.collect_list(place)).alias("__found")
    )
    vector = F.transform("__numbers", lambda x, i: F.when(F.get("__cats", i), F.coalesce(x, F.try_element_at("__found", i))).otherwise(x))
    return grouped.select(*keys, vector.alias("features"))


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def _entries(c: Column, dtype: T.ArrayType | T.MapType) -> tuple[Column, list[tuple[str | None, T.DataType]]]:
    """Items of a list or map, and the parts of an item in walk order."""
    if isinstance(dtype, T.ArrayType):
        return c, [(None, dtype.elementType)]
    return F.map_entries(c), [("key", dtype.keyType), ("value", dtype.valueType)]


def _part(item: Column, name: str | None) -> Column:
    return item if name is None else item[name]


def _width(c: Column, dtype: T.DataType) -> Column:
    """Numbers that a value takes in a vector; a missing one takes one at every level."""
    if isinstance(dtype, T.StructType):
        out = sum((_width(c[f.name], f.dataType) for f in dtype), F.lit(len(dtype)))
    elif _nested(dtype):
        items, parts = _entries(c, dtype)
        if any(_nested(t) for _, t in parts):
            out = F.aggregate(items, F.lit(0), lambda n, e: n + sum((_width(_part(e, k), t) for k, t in parts), F.lit(0)))
        else:
            out = F.size(items) * len(parts)
    else:
        return F.lit(1)
    return F.when(c.isNull(), F.lit(1)).otherwise(out)


def _texts(c: Column, dtype: T.DataType) -> Column:
    """Per place of a value's vector: does it hold the category of a text?  Names of fields and NULLs do not count."""
    no = F.array(F.lit(False))
    if isinstance(dtype, T.StructType):
        parts = [p for f in dtype for p in (no, _texts(c[f.name], f.dataType))]
        out = F.concat(*parts) if parts else F.array().cast("array<boolean>")
    elif _nested(dtype):
        items, parts = _entries(c, dtype)
        out = F.flatten(F.transform(items, lambda e: F.concat(*[_texts(_part(e, k), t) for k, t in parts])))
    else:
        out = F.array(F.lit(isinstance(dtype, T.StringType)))
    return F.when(c.isNull(), no).otherwise(out)


def unflatten_features(
    df: DataFrame, keys: list[str], vector: str, like: str, categories: DataFrame
) -> DataFrame:
    """Vectors back to nested values shaped like the value in ``like``.

    What is NULL in ``like``, at any level, took one number and comes back as NULL.  Category
    numbers, and no others, are rounded and looked up by a join; NaN times become NULL, as do
    numbers that their type cannot hold; times out of range become open bounds.
    """
    dtype = df.schema[like].dataType
    places = F.transform(_texts(F.col(like), dtype), lambda is_text, i: F.when(is_text, F.struct(i.alias("pos"), F.get(F.col(vector), i).alias("x"))))
    texts = df.select(*keys, F.inline(F.filter(places, lambda e: e.isNotNull())))
    texts = texts.withColumn("__id", F.rint("x").try_cast("long"))
    names = categories.where("category IS NOT NULL").select(F.col("category_id").alias("__id"), "category")
    looked = texts.join(names, "__id").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "category"))).alias("__texts"))

    def walk(c, t, at):
        """The value of the vector from offset ``at`` on."""
        if isinstance(t, T.StructType):
            fields = []
            for f in t:
                fields.append(walk(c[f.name], f.dataType, at + 1).alias(f.name))
                at = at + 1 + _width(c[f.name], f.dataType)
            out = F.struct(*fields) if fields else c
        elif _nested(t):
            items, parts = _entries(c, t)

            def item(e, start):
                made = []
                for k, part in parts:
                    made.append(walk(_part(e, k), part, start))
                    start = start + _width(_part(e, k), part)
                # A key that has no category stays as it is.
                return made[0] if len(made) == 1 else F.struct(F.coalesce(made[0], e["key"]).alias("key"), made[1].alias("value"))

            widths = F.transform(items, lambda e: sum((_width(_part(e, k), part) for k, part in parts), F.lit(0)))
            starts = lambda w: F.when(
                F.array_min(w) == F.array_max(w), F.transform(w, lambda n, i: at + n * i)
            ).otherwise(F.aggregate(w, F.array(at), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n))))
            # Lambdas name widths and offsets, so that they are computed once.
            placed = F.get(F.transform(F.array(widths), starts), F.lit(0))
            out = F.get(F.transform(F.array(placed), lambda s: F.transform(items, lambda e, i: item(e, F.get(s, i)))), F.lit(0))
            out = F.map_from_entries(out) if isinstance(t, T.MapType) else out
        elif isinstance(t, T.StringType):
            out = F.try_element_at(F.col("__texts"), at)
        else:
            x = F.get(F.col(vector), at)
            if isinstance(t, T.DateType):
                out = F.date_from_unix_date((x / 86_400).try_cast("int"))
            elif isinstance(t, _TIMES):
                out = F.when(~F.isnan(x), dates.from_epoch(x)).cast(t)
            elif isinstance(t, T.IntegralType):
                out = F.rint(x).try_cast(t)
            else:
                out = x.try_cast(t)
        return F.when(c.isNotNull(), out)

    return df.join(looked, keys, "left").select(*keys, walk(F.col(like), dtype, F.lit(0)).alias("value"))


def lag_panel(
    series: DataFrame, keys: list[str], order: str, value: str, window_size: int = WINDOW
) -> DataFrame:
    """Each row with the last ``window_size`` values of its series, oldest first.

    Series are cut into stretches of ten windows; every stretch also gets the last rows
    of the one before (a tenth more rows), so stretches run independently and a long
    series spreads over tasks.
    """
    stretch = 10 * window_size
    placed = rank_in_group(series, keys, [order], "__rn").withColumn("__at", F.col("__rn") - 1)
    home = F.floor(F.col("__at") / stretch)
    at_end = F.col("__at") % stretch >= stretch - (window_size - 1)
    stretches = F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home))
    lent = placed.select("*", F.explode(stretches).alias("__stretch")).withColumn("__own", F.col("__stretch") == home)
    back = Window.partitionBy(*keys, "__stretch").orderBy("__at").rowsBetween(-(window_size - 1), 0)
    # A struct keeps NULL values, which collect_list alone would drop.
    lags = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(back), lambda e: e["v"])
    return (
        lent.withColumn("history", lags).where("__own")
        .select(*series.columns, (F.col("__at") + 1).alias("n_seen"), "history")
    )


def forecast(
    panel: DataFrame,
    keys: list[str],
    window_size: int,
    value: str = "value",
    predictor: Callable[[list[float]], float] | None = None,
) -> DataFrame:
    """``prediction`` of the next value of every series from its last ``window_size`` values, and its ``method``.

    ``panel`` comes from ``lag_panel`` with one value more than ``window_size``.  By
    default one linear regression is fitted on all lag rows without NULLs (distributed;
    features are the lags): method ``regression``.  Series that are shorter than the window
    or have a NULL in it, and all if no row can be learned from, repeat their last value
    that is not NULL: method ``last``.  A ``predictor`` gets one history per series as a
    list, NULLs as None, in Arrow batches: method ``predictor``.
    """
    if panel.isEmpty():
        raise ValueError("Cannot make prediction when there is no data")
    last = panel.groupBy(*keys).agg(F.max_by(F.struct("history", "n_seen"), "n_seen").alias("__l"))
    recent = F.slice(F.col("__l.history"), F.greatest(F.size("__l.history") - window_size + 1, F.lit(1)), window_size)
    query = last.select(*keys, recent.alias("history"))
    if predictor is not None:
        schema = T.StructType([query.schema[k] for k in keys] + [T.StructField("prediction", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [float(predictor(h)) for h in batch.column("history").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(made, pa.float64())], [*keys, "prediction"])

        return query.mapInArrow(run, schema).withColumn("method", F.lit("predictor"))

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    def whole(lags: Column) -> Column:
        return (F.size(lags) == window_size) & F.forall(lags, lambda v: v.isNotNull())

    def vector(lags: Column) -> Column:
        # The condition is repeated, as Spark may compute the vector before it filters.
        return F.when(whole(lags), array_to_vector(F.when(whole(lags), lags.cast("array<double>")).otherwise(F.array(F.lit(0.0)))))

    def repeated(rows: DataFrame) -> DataFrame:
        known = F.filter("history", lambda v: v.isNotNull())
        return rows.select(*keys, F.get(known, F.size(known) - 1).cast("double").alias("prediction"), F.lit("last").alias("method"))

    lags = F.slice("history", 1, window_size)
    train = panel.where((F.size("history") > window_size) & whole(lags) & F.col(value).isNotNull()).select(
        vector(lags).alias("features"), F.col(value).cast("double").alias("label")
    )
    if train.isEmpty():
        return repeated(query)
    model = LinearRegression(regParam=1e-6).fit(train)
    full = query.where(whole(F.col("history"))).withColumn("features", vector(F.col("history")))
    fitted = model.transform(full).select(*keys, "prediction", F.lit("regression").alias("method"))
    return fitted.unionByName(repeated(query.where(~whole(F.col("history")))))


def vector_panel(own: DataFrame, inputs: dict[str, DataFrame], keys: list[str], order: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """``keys, order, features, width`` and the category map of all series.

    ``features`` has the flat own value, ``width`` long, and behind it every input's flat
    value of the same key and range; an input that has none there counts as NULL.
    """
    by = [*keys, order]
    categories = cut_lineage(shared_categories([(own, value), *[(df, value) for df in inputs.values()]]))
    null_id = categories.where("category IS NULL").select(F.col("category_id").cast("double")).first()
    missing = F.array(F.lit(null_id[0] if null_id else 0.0))
    panel = flatten_features(own, by, value, categories).withColumn("width", F.size("features"))
    for i, df in enumerate(inputs.values()):
        flat = flatten_features(df, by, value, categories).withColumnRenamed("features", f"__input{i}")
        panel = panel.join(flat, by, "left")
    vector = F.concat("features", *[F.coalesce(F.col(f"__input{i}"), missing) for i in range(len(inputs))])
    return panel.select(*by, vector.alias("features"), "width"), categories


#: Numbers of products a task holds before it hands them on.
HELD = 1 << 23


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (nx, ny, centred x and y) to summed products, one row per shape and x."""
    import numpy as np

    held: dict[tuple[int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (nx, ny), m in held.items():
            sums = pa.ListArray.from_arrays(pa.array(np.arange(nx + 1, dtype=np.int32) * (nx + ny)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(nx, nx, np.int32)), pa.array(np.full(nx, ny, np.int32)), pa.array(np.arange(nx, dtype=np.int32)), sums], ["nx", "ny", "i", "sums"]
            )
        held.clear()

    for batch in batches:
        nx, ny = (batch.column(c).to_numpy() for c in ("nx", "ny"))
        for shape in sorted(set(zip(nx.tolist(), ny.tolist()))):
            own = batch.filter(pa.array((nx == shape[0]) & (ny == shape[1])))
            z = own.column("z").flatten().to_numpy().reshape(own.num_rows, sum(shape))
            held[shape] = held.get(shape, 0.0) + z[:, : shape[0]].T @ z
        if sum(m.size for m in held.values()) > HELD:
            yield from flush()
    yield from flush()


def multi_ridge(train: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """``nx, ny, mean, weights`` of a linear regression of all ``y`` on all ``x``, per pair of lengths.

    All outputs share one matrix of summed products of the centred values, made by the tasks and
    added up by Spark; each shape is then solved once.  ``ridge`` is in units of each input's
    variance, and inputs that never vary get no weight.  ``weights`` has a list per output.
    """
    shaped = train.select(F.size("x").alias("nx"), F.size("y").alias("ny"), F.concat("x", "y").alias("z")).where("nx > 0 AND ny > 0")
    means = shaped.select("nx", "ny", F.posexplode("z")).groupBy("nx", "ny", "pos").agg(F.avg("col").alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"])
    means = cut_lineage(means.groupBy("nx", "ny").agg(mean.alias("mean")))
    centred = shaped.join(means, ["nx", "ny"]).select("nx", "ny", F.zip_with("z", "mean", lambda z, m: z - m).alias("z"))
    sums = centred.mapInArrow(_products, "nx int, ny int, i int, sums array<double>").select("nx", "ny", "i", F.posexplode("sums").alias("j", "s"))
    totals = sums.groupBy("nx", "ny", "i", "j").agg(F.sum("s").alias("s"))

    def solve(table: pa.Table) -> pa.Table:
        import numpy as np

        nx, ny = table["nx"][0].as_py(), table["ny"][0].as_py()
        m = np.zeros((nx, nx + ny))
        m[table["i"].to_numpy(), table["j"].to_numpy()] = table["s"].to_numpy()
        spread = np.sqrt(np.diag(m[:, :nx]))
        scale = np.where(spread > 0, spread, 1.0)
        gram = m[:, :nx] / np.outer(scale, scale) + ridge * np.eye(nx)
        weights = np.linalg.pinv(gram, hermitian=True, rcond=1e-13) @ (m[:, nx:] / scale[:, None]) / scale[:, None]
        weights[spread == 0] = 0.0
        return pa.table({"nx": pa.array([nx], pa.int32()), "ny": pa.array([ny], pa.int32()), "weights": pa.array([weights.T.tolist()], pa.list_(pa.list_(pa.float64())))})

    return means.join(totals.groupBy("nx", "ny").applyInArrow(solve, "nx int, ny int, weights array<array<double>>"), ["nx", "ny"])


def forecast_nested(
    own: DataFrame,
    inputs: dict[str, DataFrame],
    keys: list[str],
    order: str,
    window_size: int = WINDOW,
    value: str = "value",
    predictor: Callable[[list[list[float]]], list[float]] | None = None,
    ridge: float = 1e-9,
) -> DataFrame:
    """``keys, prediction, method``: the next value of every series, of the type of its values.

    ``own`` and every table of ``inputs`` have ``keys``, ``order`` (unique together) and a value
    of any type that can be flattened.  The last ``window_size`` ranges of own and input values
    are one vector; a regression of the next own value's vector on it is fitted over all series,
    per pair of lengths, and its prediction takes the shape of the last own value (method
    ``regression``).  Series shorter than the window, with NaN in it, or of lengths that no
    training row has, repeat their last value (``last``).  A ``predictor`` gets the
    window's vectors, oldest first, shorter for short series, and returns the own value's vector
    (``predictor``).
    """
    if own.isEmpty() and all(df.isEmpty() for df in inputs.values()):
        raise ValueError("Cannot make prediction when there is no data")
    panel, categories = vector_panel(own, inputs, keys, order, value)
    row = F.struct("features", "width")
    lagged = cut_lineage(lag_panel(panel.withColumn("row", row), keys, order, "row", window_size + 1))
    last = lagged.groupBy(*keys).agg(F.max_by("history", order).alias("history"))
    shape = own.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), order)["v"].alias("__like"))
    recent = F.slice("history", F.greatest(F.size("history") - window_size + 1, F.lit(1)), window_size)
    ny = F.element_at("history", -1)["width"]
    # NaN takes no part: neither as an input nor as what is learned.
    whole = lambda c: ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    flat = lambda h: F.flatten(F.transform(h, lambda r: r["features"]))
    query = last.select(*keys, recent.alias("recent"), ny.alias("ny")).join(shape, keys)
    if predictor is not None:
        fields = [query.schema[k] for k in keys]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [[float(x) for x in predictor(h)] for h in batch.column("vectors").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(made, pa.list_(pa.float64()))], [*keys, "__vector"])

        vectors = query.select(*keys, F.transform("recent", lambda r: r["features"]).alias("vectors"))
        made = vectors.mapInArrow(run, T.StructType([*fields, T.StructField("__vector", T.ArrayType(T.DoubleType()))]))
        predicted = query.join(made, keys).withColumn("method", F.lit("predictor"))
    else:
        full = F.size("history") == window_size + 1
        target = F.slice(F.element_at("history", -1)["features"], 1, ny)
        train = lagged.where(full).select(flat(F.slice("history", 1, window_size)).alias("x"), target.alias("y"))
        model = multi_ridge(train.where(whole(F.col("x")) & whole(F.col("y"))), ridge)
        x = flat(F.col("recent"))
        asked = query.withColumn("__x", F.when(F.size("recent") == window_size, x)).withColumn("nx", F.size("__x"))
        joined = asked.join(model, ["nx", "ny"], "left")
        moved = F.zip_with("__x", F.slice("mean", 1, F.col("nx")), lambda v, m: v - m)
        output = F.transform(
            "weights",
            lambda w, j: F.get("mean", F.col("nx") + j) + F.aggregate(F.zip_with(moved, w, lambda v, c: v * c), F.lit(0.0), lambda a, b: a + b),
        )
        usable = F.col("weights").isNotNull() & whole(F.col("__x"))
        predicted = joined.withColumn("__vector", F.when(usable, output)).withColumn("method", F.when(usable, "regression").otherwise("last"))
    back = unflatten_features(predicted, keys, "__vector", "__like", categories).withColumnRenamed("value", "prediction")
    out = predicted.select(*keys, "__like", "method").join(back, keys)
    return out.select(*keys, F.when(F.col("method") == "last", F.col("__like")).otherwise(F.col("prediction")).alias("prediction"), "method")
