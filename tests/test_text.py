import random

from pyspark.sql import functions as F

from paneltide.functions import text


def brute(a, b):
    a, b = a or "", b or ""
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)


def test_edit_distance(spark):
    rows = [("kitten", "sitting", 3 / 13), ("kitten", "", 1.0), ("", "", 0.0), (None, None, 0.0), (None, "test", 1.0),
            ("hello", "hello", 0.0), ("abcdef", "azced", 3 / 11)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select("want", text.edit_distance(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r.got - r.want) < 1e-12


def test_common_substring_both_ways(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(rng.randrange(n)))
    rows = [("abc", "zabcy"), ("abcd", "abcd"), ("abc", "xyz"), ("hello", "he"), ("", "a"), (None, "a"), ("a", None)]
    rows += [(word(14), word(14)) for _ in range(120)] + [(word(300) + "needle" + word(300), word(200) + "needle" + word(9))]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", text.common_substring_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == brute(r.a, r.b) for r in got)
    short = df.where("coalesce(length(a), 0) < 20").select(
        "a", "b", text.common_substring_length_short(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == brute(r.a, r.b) for r in short)


SAMPLES = ["", "a", "a\n", "a\n\n", "  a\n    b\n\n  c", "\ta\n\t\tb", "  a\r\n  b\x0bc", "no\n  indent", "   ", "x y",
           "import os\nfrom a import b\n  import c\nkept\n", "\n\nimport x\n  body  \n"]


def test_lines_dedent_imports(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    c = F.col("t")
    for r in df.select("t", text.split_lines(c).alias("lines"), text.dedent(c).alias("d"),
                       text.drop_import_lines(c).alias("all"), text.drop_import_lines(c, True).alias("top")).collect():
        lines = r.t.splitlines()
        assert r.lines == lines
        indents = [len(x) - len(x.lstrip()) for x in lines if x.strip()]
        cut = min(indents, default=0)
        assert r.d == (r.t if not cut else "\n".join(x[cut:] if x.strip() else "" for x in lines))
        keep = lambda x: not x.startswith(("import ", "from "))
        assert r.top == "\n".join(x for x in lines if keep(x)).strip()
        assert r["all"] == "\n".join(x for x in lines if keep(x.strip())).strip()


def test_preview(spark):
    df = spark.createDataFrame([("x" * 500,), ("a" * 300 + "b" * 300,)], "t string")
    short, long = [r.p for r in df.select(text.preview(F.col("t"), F.lit("{}")).alias("p")).collect()]
    assert short == "x" * 500
    assert long.startswith("a" * 250 + "\n...\n" + "b" * 250 + "\n\nValue too large to show.") and long.endswith("{}")
