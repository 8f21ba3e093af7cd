"""Profiles of tables, texts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from paneltide.functions.binding import let
from paneltide.functions.files import extension, image_header
from paneltide.functions.text import split_lines, strip
from paneltide.sources.files import read_files

# How much of a file a profile shows.
HEAD_ROWS = 5
HEAD_ITEMS = 3
HEAD_TAGS = 10
UNSUPPORTED = "Unsupported file type. Data metadata shown."


def bounding_box(points: DataFrame, x: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """Smallest and largest x and y; NULLs when there are no points."""
    return points.groupBy(*(by or [])).agg(
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y")
    )


def column_type_name(dtype: T.DataType) -> str:
    """Column type as a data-analysis library names it."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return {"tinyint": "int8", "smallint": "int16", "int": "int32"}.get(dtype.simpleString(), "int64")
    if isinstance(dtype, T.FloatType):
        return "float32"
    if isinstance(dtype, T.DoubleType):
        return "float64"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    return "object"


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, with the table's rows and columns.

    Rows are counted by one aggregate (from file footers where Parquet allows).
    """
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.lit(column_type_name(f.dataType)).alias("dtype"))
            for i, f in enumerate(df.schema)
        ]
    )
    counted = df.agg(F.count("*").alias("num_rows"))
    return counted.select("num_rows", F.lit(len(df.columns)).alias("num_columns"), F.inline(columns))


def head_rows(df: DataFrame, order_by: list[str], n: int = HEAD_ROWS, by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, of the table or of each group.

    Grouped heads keep at most ``n`` rows per group and task before the shuffle (Spark
    pushes the rank limit below the exchange).
    """
    if not by:
        return df.orderBy(*order_by).limit(n)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    return df.withColumn("rn", rn).where(F.col("rn") <= n)


def profile_text(c: Column) -> Column:
    """Line count and the first lines of a text."""
    return let(
        split_lines(c),
        lambda lines: F.struct(
            F.size(lines).alias("line_count"),
            F.array_join(F.slice(lines, 1, HEAD_ROWS), "\n").alias("preview"),
        ),
    )


def profile_json(c: Column) -> Column:
    """Item count and first items of JSON text; NULL count for scalars, error for bad text."""

    def summary(parsed):
        items = F.try_variant_get(parsed, "$", "array<variant>")
        # Field order is the text's; a parsed variant would sort the names.
        fields = F.map_entries(F.from_json(c, "map<string, variant>"))
        schema = F.schema_of_variant(parsed)
        is_list, is_object = F.startswith(schema, F.lit("ARRAY<")), F.startswith(schema, F.lit("OBJECT<"))
        sample = (
            F.when(is_list, F.to_json(F.slice(items, 1, HEAD_ITEMS)))
            .when(is_object, F.to_json(F.map_from_entries(F.slice(fields, 1, HEAD_ITEMS))))
            .otherwise(c)
        )
        count = F.when(is_list, F.size(items)).when(is_object, F.size(F.json_object_keys(c)))
        return F.struct(
            count.alias("item_count"),
            F.when(parsed.isNotNull(), sample).alias("sample"),
            schema.alias("schema"),
            F.when(parsed.isNull(), F.lit("Failed to process file: not JSON")).alias("error"),
        )

    return let(F.try_parse_json(c), summary)


def _markup(c: Column) -> Column:
    for pattern in (r"(?s)<!--.*?-->", r"(?s)<!\[CDATA\[.*?\]\]>", r"(?s)<\?.*?\?>", r"(?s)<![A-Za-z][^>]*>"):
        c = F.regexp_replace(c, pattern, "")
    return c


def profile_xml(c: Column) -> Column:
    """Root tag, element count and first distinct tags in document order.

    Unbalanced markup is reported in ``error``; tags are named as written, prefix
    included.
    """

    def summary(found):
        tags = found["tags"]
        bad = (F.size(tags) == 0) | (F.size(tags) != found["closed"])
        return F.struct(
            F.get(tags, F.lit(0)).alias("root_tag"),
            F.size(tags).alias("num_elements"),
            F.slice(F.array_distinct(tags), 1, HEAD_TAGS).alias("sample_tags"),
            F.when(bad, F.lit("Failed to process file: not well-formed")).alias("error"),
        )

    def scan(bare):
        ends = F.regexp_extract_all(bare, F.lit(r"</[A-Za-z_]|<[A-Za-z_][^<>]*/>"), F.lit(0))
        tags = F.regexp_extract_all(bare, F.lit(r"<([A-Za-z_][^\s/>]*)"), F.lit(1))
        return F.struct(tags.alias("tags"), F.size(ends).alias("closed"))

    return let(let(_markup(c), scan), summary)


def profile_image(spark: SparkSession, path: str) -> DataFrame:
    """Width, height, channels and format of the images below a path."""
    images = spark.read.format("image").load(path).select("image.*")
    names = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB").when(F.col("nChannels") == 4, "RGBA")

    def place(c: str) -> Column:
        # The two readers write a local path with one or three slashes.
        return F.regexp_replace(c, "^file:/+", "file:/").alias("path")

    kinds = read_files(spark, path).select(place("path"), image_header(F.col("content"))["format"].alias("format"))
    sized = images.select(place("origin"), "width", "height", names.alias("mode"))
    name = F.substring_index("path", "/", -1).alias("file_name")
    return sized.join(kinds, "path").select(name, "path", "format", "mode", "width", "height")


def _delimited(text: Column, separator: str) -> Column:
    """Rows, columns, names, types and head of delimited text held in one cell.

    Quoted fields may hold separators and line ends.  Large tables are read with
    ``read_by_type`` and profiled with ``profile_table`` instead.
    """
    quoted = r'"(?:[^"]|"")*"'
    hidden = F.transform(
        F.regexp_extract_all(text, F.lit(rf'{quoted}|[^"]+'), F.lit(0)),
        lambda t: F.when(F.startswith(t, F.lit('"')), F.translate(t, "\n\r" + separator, "  ")).otherwise(t),
    )
    lines = F.filter(split_lines(F.array_join(hidden, "")), lambda line: strip(line) != "")

    def cells(line):
        return F.transform(F.split(line, separator, -1), lambda s: F.regexp_replace(strip(s), r'^"|"$', ""))

    def kind(rows, i):
        values = F.transform(rows, lambda r: F.nullif(F.get(r, i), F.lit("")))

        def named(v):
            whole = F.forall(v, lambda x: F.coalesce(x.rlike(r"^[+-]?\d+$"), F.lit(False)))
            truth = F.forall(v, lambda x: F.coalesce(x.rlike("^(True|False|TRUE|FALSE|true|false)$"), F.lit(False)))
            number = F.forall(v, lambda x: x.isNull() | x.try_cast("double").isNotNull())
            return (
                F.when(F.size(v) == 0, F.lit("object")).when(whole, F.lit("int64")).when(truth, F.lit("bool"))
                .when(number, F.lit("float64")).otherwise(F.lit("object"))
            )

        return let(values, named)

    def summary(lines):
        body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))

        def shaped(t):
            width = F.size(t["header"])
            return F.struct(
                F.size(t["rows"]).alias("num_rows"),
                width.alias("num_columns"),
                t["header"].alias("columns"),
                F.transform(F.sequence(F.lit(0), width - 1), lambda i: kind(t["rows"], i)).alias("dtypes"),
                F.array_join(F.slice(lines, 2, HEAD_ROWS), "\n").alias("head"),
            )

        table = F.struct(cells(F.get(lines, F.lit(0))).alias("header"), F.transform(body, cells).alias("rows"))
        return F.when(F.size(lines) > 0, let(table, shaped))

    return let(lines, summary)


def profile_files(files: DataFrame) -> DataFrame:
    """Profile each file (path, content, ...) by its extension; errors stay in the row.

    Two projections and no shuffle: the first computes the profile of the file's own
    type, the second spreads it over columns.
    """
    text, ext = F.col("__text"), F.col("__ext")
    csv, tsv = ext == "csv", ext == "tsv"
    plain, js, xml = ext.isin("txt", "md", "log"), ext == "json", ext == "xml"
    image = ext.isin("png", "jpg", "jpeg", "gif", "bmp")
    readable = F.is_valid_utf8(text)
    named = files.withColumn("__ext", extension(F.col("path"))).withColumn("__text", F.col("content").cast("string"))
    staged = named.withColumns(
        {
            "__ok": readable,
            "__table": F.when(csv & readable, _delimited(text, ",")).when(tsv & readable, _delimited(text, "\t")),
            "__lines": F.when(plain & readable, profile_text(text)),
            "__json": F.when(js & readable, profile_json(text)),
            "__xml": F.when(xml & readable, profile_xml(text)),
            "__image": F.when(image, image_header(F.col("content"))),
        }
    )
    error = (
        F.when((csv | tsv | plain | js | xml) & ~F.col("__ok"), F.lit("Failed to process file: not UTF-8"))
        .when(js, F.col("__json.error"))
        .when(xml, F.col("__xml.error"))
        .when((csv | tsv) & F.col("__table").isNull(), F.lit("Failed to process file: no columns to parse"))
        .when(image & F.col("__image").isNull(), F.lit("Failed to process file: cannot identify image"))
    )
    kind = F.when(plain, F.lit("text")).when(image, F.lit("image")).otherwise(ext)
    supported = csv | tsv | plain | js | xml | image
    return staged.withColumn("error", error).select(
        F.substring_index("path", "/", -1).alias("file_name"),
        *[c for c in ("modificationTime", "length") if c in files.columns],
        F.when(F.col("error").isNull(), kind).alias("file_type"),
        *[f"__table.{n}" for n in ("num_rows", "num_columns", "columns", "dtypes", "head")],
        "__json.item_count", "__json.sample",
        "__lines.line_count", "__lines.preview",
        "__xml.root_tag", "__xml.num_elements", "__xml.sample_tags",
        "__image.format", "__image.mode", "__image.width", "__image.height",
        F.when(~supported, F.lit(UNSUPPORTED)).alias("note"),
        "error",
    )
