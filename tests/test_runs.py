"""Functions over cells, reports, graphs, features, profiles, sources, streams."""

import datetime as dt
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.files import guess_file_type
from paneltide.operators import features, graph, profile, reports, run
from paneltide.sources import files, jdbc
from paneltide.sources.changes import read_change_feed
from paneltide.streaming import changes, periods, runner


def cells(spark, n=6):
    return spark.createDataFrame(
        [("a", "data" if i % 2 else "notes", i, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), float(i)) for i in range(n)],
        "full_name string, attribute_name string, clone_num int, tr_start timestamp, tr_end timestamp, x double")


def test_captured_output(spark):
    def fn(clone_num, x, time_range=None):
        print("one")
        print("two")
        if clone_num == 1:
            raise ValueError("boom")
        if clone_num == 2:
            return "not a number"
        return x + (100 if time_range else 0)

    rows = {r.clone_num: r for r in run.map_cells(cells(spark), fn, T.DoubleType(), ["x"]).collect()}
    assert rows[0].value == 0.0 and rows[3].value == 103.0 and not rows[0].failed
    assert rows[0].combined_output == "[stdout] one\n[stdout] two" and rows[0].stdout_output == "one\ntwo"
    assert rows[1].failed and rows[1].value is None and rows[1].stderr_output.endswith("ValueError: boom")
    assert "[stderr]" in rows[1].combined_output and "captured" not in rows[1].stderr_output
    assert rows[2].failed and "output validation failed" in rows[2].stderr_output


def test_chunks_and_failures(spark):
    def gen(clone_num, x, time_range=None):
        for i in range(clone_num):
            if i == 3:
                raise RuntimeError("late")
            yield float(i)

    out = run.map_chunks(cells(spark), gen, T.DoubleType(), ["x"], ["clone_num"])
    good = run.drop_failed(out, ["clone_num"]).collect()
    assert sorted((r.clone_num, r.chunk_num) for r in good) == [(c, i) for c in range(4) for i in range(c)]
    assert {r.clone_num for r in out.where("failed").collect()} == {4, 5}
    stored = cells(spark).select("clone_num", F.lit(-1.0).alias("value"))
    last = {r.clone_num: r.value for r in run.carry_forward(out.where("failed"), stored, ["clone_num"]).collect()}
    assert last == {4: -1.0, 5: -1.0}


def test_fold_in_slices_equals_fold_in_one_piece(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 2], i, float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(6)

    def step(state, row):
        total, count = state
        return (total + row["x"], count + 1), total / count if count else -1.0

    once = run.fold_history(df, step, lambda: (0.0, 0), T.DoubleType(), ["k"], ["i"])
    sliced = run.fold_history(df, step, lambda: (0.0, 0), T.DoubleType(), ["k"], ["i"],
                              merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), slice_by=F.floor(F.col("i") / 37))
    a = {r.i: r.value for r in once.collect()}
    b = {r.i: r.value for r in sliced.collect()}
    assert a.keys() == b.keys() == set(range(400)) and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    seen = {"a": [], "b": []}
    for k, i, x in rows:
        assert abs(a[i] - (sum(seen[k]) / len(seen[k]) if seen[k] else -1.0)) < 1e-9
        seen[k].append(x)


def test_switch_and_registry(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    assert cells(spark).select(run.train_predict_switch(at, F.lit(1), F.lit(2)).alias("v")).first().v == 2
    assert run.register_functions(spark, {"plus": (lambda s: s + 1, T.LongType()), "noop": (None, T.LongType())}) == ["plus"]
    assert spark.sql("SELECT plus(41L) AS v").first().v == 42


def test_report_keeps_inner_blank_entries(spark):
    rows = [("a", 1, 1, False, ""), ("a", 1, 2, False, " x "), ("a", 1, 3, True, ""), ("a", 1, 4, False, "y"), ("a", 1, 5, False, ""),
            ("a", 2, 6, False, "z"), ("b", 1, 7, False, "")]
    df = spark.createDataFrame(rows, "doc string, ctx int, seq int, failed boolean, combined_output string")
    out = {(r.doc, r.segment): r for r in reports.run_report(df, ["doc"], ["ctx"], "seq", F.lit("v1")).collect()}
    assert out["a", 0].combined_output == "While running 1:\nx\n\ny\nWhile running 2:\nz" and out["a", 0].failed
    assert out["b", 0].combined_output == "" and not out["b", 0].failed
    cut = reports.run_report(df, ["doc"], ["ctx"], "seq", F.lit("v1"), lines_per_segment=2).where("doc = 'a'").orderBy("segment").collect()
    assert "\n".join(r.combined_output for r in cut) == out["a", 0].combined_output and len(cut) == 2


def test_report_carries_all_logs(spark):
    rows = [("a", 1, 1, False, "x", ""), ("a", 1, 2, False, None, "e"), ("b", 1, 3, True, "", " f ")]
    df = spark.createDataFrame(rows, "doc string, ctx int, seq int, failed boolean, stdout string, stderr string")
    out = {r.doc: r for r in reports.run_report(df, ["doc"], ["ctx"], "seq", F.lit("v1"), logs=("stdout", "stderr")).collect()}
    assert (out["a"].stdout, out["a"].stderr) == ("While running 1:\nx", "While running 1:\ne")
    assert (out["b"].stdout, out["b"].stderr, out["b"].failed) == ("", "While running 1:\nf", True)


def test_forecast_with_null_lags(spark):
    rows = [(k, i, None if (k, i) in ((1, 3), (2, 9)) else float(k + i)) for k in range(6) for i in range(10)]
    panel = features.lag_panel(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", window_size=4)
    out = {r.k: (r.prediction, r.method) for r in features.forecast(panel, ["k"], 3, value="v").collect()}
    assert out[2] == (10.0, "last") and out[1][1] == "regression" and abs(out[1][0] - 11) < 0.01
    named = {r.k: r for r in features.forecast(panel, ["k"], 3, value="v", predictor=lambda h: h.count(None)).collect()}
    assert named[2].prediction == 1.0 and named[1].prediction == 0.0


def test_tree_layout(spark):
    edges = [("root", "child1", 0), ("root", "child2", 1), ("child1", "grandchild1", 2), ("child1", "grandchild2", 3)]
    df = spark.createDataFrame(edges, "parent string, child string, ord int")
    want = {"root": (0, 0), "child1": (0, 100), "child2": (100, 100), "grandchild1": (0, 200), "grandchild2": (100, 200)}
    for directed in (True, False):
        assert {r.node: (r.x, r.y) for r in graph.hierarchy_levels(df, "root", directed=directed).collect()} == want


def test_random_trees(spark):
    rng = random.Random(4)
    parents = {i: rng.randrange(i) for i in range(1, 80)}
    df = spark.createDataFrame([(str(p), str(c), c) for c, p in parents.items()], "parent string, child string, ord int")
    levels, order = {}, []

    def visit(node, level):
        levels[node] = level
        order.append(node)
        for child in sorted(c for c, p in parents.items() if p == node):
            visit(child, level + 1)

    visit(0, 0)
    seen = {}
    want = {}
    for node in order:
        want[str(node)] = (levels[node], seen.setdefault(levels[node], 0))
        seen[levels[node]] += 1
    assert {r.node: (r.level, r.rank) for r in graph.hierarchy_levels(df, "0").collect()} == want


def test_failures_travel(spark):
    edges = spark.createDataFrame([("b", "data", 1, "a"), ("c", "data", 1, "x"), ("c", "data", 2, "b"), ("d", "data", 1, "x"), ("a", "z", 1, "c")],
                                  "doc_id string, attribute_name string, ord int, input_doc_id string")
    failed = spark.createDataFrame([("a", "data"), ("a", "meta")], "doc_id string, attribute_name string")
    out = {(r.doc_id, r.attribute_name): (r.level, r.message) for r in graph.propagate_failures(edges, failed).collect()}
    assert set(out) == {("a", "data"), ("a", "meta"), ("b", "data"), ("c", "data"), ("a", "z")}
    assert out["b", "data"] == (1, "Upstream failure from a: ['data', 'meta', 'z']")
    assert out["c", "data"] == (2, "Upstream failure from b: ['data']") and out["a", "data"] == (0, None)


def test_categories_and_vectors(spark):
    kind = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StructType([
        T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("l", T.ArrayType(T.StringType())),
        T.StructField("t", T.TimestampType())]))])
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, ("b", 2.5, ["a", None], at)), (2, ("__UNK__", 1.0, [], at))], kind)
    cats = features.build_categories(df, ["v"])
    ids = {r.category: r.category_id for r in cats.collect()}
    assert ids["__UNK__"] == 0
    rest = [c for c in ids if c != "__UNK__"]
    assert [c for c in sorted(rest, key=lambda c: ids[c])] == sorted(rest, key=str) and sorted(ids[c] for c in rest) == list(range(1, len(rest) + 1))
    flat = features.flatten_features(df, ["id"], "v", cats)
    vectors = {r.id: r.features for r in flat.collect()}
    k = lambda c: float(ids[c])
    assert vectors[1] == [k("s"), k("b"), k("n"), 2.5, k("l"), k("a"), k(None), k("t"), 1704067200.0]
    assert vectors[2] == [k("s"), 0.0, k("n"), 1.0, k("l"), k("t"), 1704067200.0]
    back = {r.id: r.value for r in features.unflatten_features(df.join(flat, "id"), ["id"], "features", "v", cats).collect()}
    assert back[1] == df.where("id = 1").first().v


def test_lag_panel_crosses_stretches(spark):
    df = spark.createDataFrame([("a", i, None if i % 7 == 0 else i) for i in range(95)] + [("b", 1, 1)], "k string, i int, v int")
    out = {(r.k, r.i): r for r in features.lag_panel(df, ["k"], "i", "v", window_size=3).collect()}
    assert len(out) == 96
    for i in range(95):
        want = [None if j % 7 == 0 else j for j in range(max(0, i - 2), i + 1)]
        assert out["a", i].history == want and out["a", i].n_seen == i + 1


def test_forecast(spark):
    df = spark.createDataFrame([(k, i, float(10 * k + 3 * i)) for k in range(4) for i in range(12)] + [(9, 0, 7.0)], "k int, i int, value double")
    panel = features.lag_panel(df, ["k"], "i", "value", window_size=4)
    out = {r.k: r.prediction for r in features.forecast(panel, ["k"], 3).collect()}
    assert all(abs(out[k] - (10 * k + 36)) < 0.1 for k in range(4)) and out[9] == 7.0
    with pytest.raises(ValueError):
        features.forecast(panel.where("k = 77"), ["k"], 3)


HEADS = [
    (b"\x89PNG\r\n\x1a\nxx", "png"), (b"\xff\xd8\xffx", "jpg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"%PDF-1", "pdf"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "xls"), (b"PK\x03\x04[Content_Types].xml xl/", "xlsx"),
    (b"PK\x03\x04[Content_Types].xml word/", "docx"), (b"PK\x03\x04[Content_Types].xml ppt/", "pptx"),
    (b"PK\x03\x04[Content_Types].xml", "zip"), (b"PK\x03\x04", "txt"), (b' {"a": 1}', "json"), (b"[1]", "json"),
    (b"a,b,c\n1,2,3", "csv"), (b"a\tb\n1\t2", "tsv"), (b"A sentence.", "txt"), (b"\x00\x01\x02\x03", "txt"), (b"\xff\xfe\x00", "bin"),
]


def test_file_types(spark):
    df = spark.createDataFrame([(bytearray(c), t) for c, t in HEADS], "content binary, want string")
    for r in df.select("want", guess_file_type(F.col("content")).alias("got")).collect():
        assert r.want == r.got


def png(width, height):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"\x80\x40\x20" * width for _ in range(height))
    return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_file_profiles(spark, tmp_path):
    contents = {
        "t.csv": b'name,age,score\n"Ann, B",1,0.5\n"x\ny",2,\n', "u.tsv": b"a\tb\n1\t2\n", "j.json": b'[1, {"a": 2}]',
        "o.json": b'{"z": 1, "a": [1], "m": null, "b": 4}', "n.txt": b"1\n2\n3\n4\n5\n6\n", "x.xml": b"<?xml version='1.0'?><r a='1'><c/><d>t</d><!-- <e> --></r>",
        "bad.json": b"{", "bad.csv": b"\xff\xfe", "bad.xml": b"<a><b></a>", "i.png": png(3, 2), "q.zzz": b"?",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.file_name: r for r in profile.profile_files(files.read_files(spark, str(tmp_path))).collect()}
    t = rows["t.csv"]
    assert (t.num_rows, t.num_columns, t["columns"], t.dtypes) == (2, 3, ["name", "age", "score"], ["object", "int64", "float64"])
    assert (rows["u.tsv"].num_rows, rows["u.tsv"].num_columns) == (1, 2)
    assert rows["j.json"].item_count == 2 and rows["o.json"].item_count == 4
    assert list(json.loads(rows["o.json"].sample)) == ["z", "a", "m"]
    assert rows["n.txt"].line_count == 6 and rows["n.txt"].preview == "1\n2\n3\n4\n5" and rows["n.txt"].file_type == "text"
    assert (rows["x.xml"].root_tag, rows["x.xml"].num_elements, rows["x.xml"].sample_tags) == ("r", 3, ["r", "c", "d"])
    assert all(rows[n].error for n in ("bad.json", "bad.csv", "bad.xml")) and rows["bad.json"].file_type is None
    assert rows["i.png"].format == "PNG" and rows["q.zzz"].note.startswith("Unsupported")
    image = profile.profile_image(spark, str(tmp_path / "i.png")).first()
    assert (image.format, image.mode, image.width, image.height) == ("PNG", "RGB", 3, 2)
    assert (rows["i.png"].mode, rows["i.png"].width, rows["i.png"].height) == ("RGB", 3, 2)


def test_images_of_one_name_in_two_folders(spark, tmp_path):
    for name, width in (("a", 3), ("b", 5)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.png").write_bytes(png(width, 2))
    out = profile.profile_image(spark, str(tmp_path / "*")).collect()
    assert sorted((r.path.split("/")[-2], r.width) for r in out) == [("a", 3), ("b", 5)]


def test_image_headers(spark):
    down = b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 7, -9, 1, 24)
    padded = b"\xff\xd8\xff\xe1\x00\x04ab\xff\xff\xc2\x00\x11\x08\x00\x05\x01\x00\x03"
    rows = [("down.bmp", down), ("padded.jpg", padded), ("cut.png", b"\x89PNG\r\n\x1a\n"), ("cut.jpg", b"\xff\xd8\xff"), ("none.gif", b"text"), ("empty.gif", b""), ("null.gif", None)]
    out = {r.file_name: r for r in profile.profile_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    got = {n: (r.format, r.mode, r.width, r.height) for n, r in out.items()}
    assert got["down.bmp"] == ("BMP", "RGB", 7, 9) and got["padded.jpg"] == ("JPEG", "RGB", 256, 5)
    assert got["cut.png"] == ("PNG", None, None, None) and got["cut.jpg"] == ("JPEG", None, None, None)
    assert all(out[n].error for n in ("none.gif", "empty.gif", "null.gif"))


def test_read_by_type(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rows><row><x>1</x></row><row><x>2</x></row></rows>")
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "a.tsv").write_text("x\ty\n1\t'q'\n")
    (tmp_path / "a.md").write_text("one\ntwo\n")
    assert files.read_by_type(spark, str(tmp_path / "a.xml"), "xml").count() == 2
    assert files.read_by_type(spark, str(tmp_path / "a.json"), "json", "x int").agg(F.sum("x")).first()[0] == 3
    assert files.read_by_type(spark, str(tmp_path / "a.tsv"), "tsv").first().x == 1
    assert files.read_by_type(spark, str(tmp_path / "a.md"), "md").count() == 2
    with pytest.raises(ValueError):
        files.read_by_type(spark, str(tmp_path), "xyz")


def test_jdbc_addresses():
    assert jdbc.jdbc_options(host="h", port=3306, database="d")["url"] == "jdbc:mysql://h:3306/d"
    got = jdbc.jdbc_options(host="h", port=5432, database="d", user="u", password="p", sql_type="postgres")
    assert got == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p"}
    assert jdbc.jdbc_options(uri="mysql://h:1", database="d")["url"] == "jdbc:mysql://h:1/d"
    assert jdbc.jdbc_options(uri="jdbc:mysql://h:1/d", database="d")["url"] == "jdbc:mysql://h:1/d"
    with pytest.raises(ValueError):
        jdbc.jdbc_options(host="h", sql_type="other")


def test_jdbc_reads_name_their_partitions(spark):
    assert jdbc.partition_options("id", (0, 100), 8) == {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    assert jdbc.partition_options(None, None, None) == {}
    for wrong in [("id", None, 8), ("id", (0, 9), None), (None, (0, 9), 8), ("id", (9, 9), 8), ("id", (0, 9), 0)]:
        with pytest.raises(ValueError):
            jdbc.partition_options(*wrong)
    for options in [{}, {"predicates": ["a = 1"], "one_task": True}, {"partition_column": "id", "bounds": (0, 9), "partitions": 2, "one_task": True}]:
        with pytest.raises(ValueError, match="one_task"):
            jdbc.read_jdbc(spark, "t", host="h", database="d", **options)


def message(i, n, op="update", gone=False):
    return {"data": json.dumps({"fullDocument": {"calc_graph_ref": "g", "is_deleted": gone, "n": n}, "documentKey": {"_id": i},
                                "operationType": op, "collection": "c", "sequence": n})}


def test_state_over_two_runs_and_late_arrivals(spark, tmp_path):
    feed, out, checkpoint = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "ck")

    def push(name, rows):
        (tmp_path / "feed").mkdir(exist_ok=True)
        (tmp_path / "feed" / name).write_text("\n".join(json.dumps(r) for r in rows))

    def catch_up():
        stream = read_change_feed(spark, feed, streaming=True).withColumn("sequence", F.get_json_object("data", "$.sequence").cast("long"))
        runner.update_log(changes.apply_changes(changes.stream_changes(stream), F.col("sequence")), out, checkpoint)
        state = changes.current_state(spark.read.parquet(out), ["id"])
        return {r.id: r.sequence for r in changes.live(state).collect()}

    push("1.json", [message("a", 1), message("b", 2), message("a", 3), message("c", 4)])
    assert catch_up() == {"a": 3, "b": 2, "c": 4}
    # A late message changes nothing; a delete and a soft delete hide their documents.
    push("2.json", [message("a", 2), message("b", 5, "delete"), message("c", 6, gone=True), message("d", 7)])
    assert catch_up() == {"a": 3, "d": 7}


def test_periods_wait_until_closed(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 1), "x", 1.0), (dt.datetime(2024, 1, 2, 1), "x", 2.0), (dt.datetime(2024, 1, 4, 1), "x", 3.0)]
    path = str(tmp_path / "events.parquet")
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double")
    df.write.parquet(path)
    total = [F.sum("v").alias("total")]
    stream = periods.period_aggregate(runner.stream_table(spark, path, df.schema), "ts", ["k"], total)
    runner.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    key = lambda out: sorted((r.tr_start, r.total) for r in out.collect())
    got = key(spark.read.parquet(str(tmp_path / "out")))
    assert got == key(periods.closed_periods(df, "ts", ["k"], total)) == [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), 2.0)]
    with pytest.raises(ValueError):
        periods.period_aggregate(df, "ts", ["k"], total, "hourly")
    later = df.union(spark.createDataFrame([(dt.datetime(2025, 2, 3), "x", 4.0)], df.schema))
    assert key(periods.closed_periods(later, "ts", ["k"], total, period="monthly")) == [(dt.datetime(2024, 1, 1), 6.0)]
    assert key(periods.closed_periods(later, "ts", ["k"], total, period="yearly")) == [(dt.datetime(2024, 1, 1), 6.0)]
    assert key(periods.closed_periods(later, "ts", ["k"], total, period="weekly")) == [(dt.datetime(2024, 1, 1), 6.0)]


def test_integers_beside_nulls_stay_integers(spark):
    big = 9007199254740993
    rows = [("a", "data", 0, 1, 2, big, float("nan")), ("a", "data", 0, 2, 3, None, None), ("a", "data", 0, 3, 4, 5, 1.0)]
    df = spark.createDataFrame(
        rows, "full_name string, attribute_name string, clone_num int, tr_start int, tr_end int, x long, y double"
    ).coalesce(1)

    def kinds(clone_num, time_range, x, y):
        return f"{type(x).__name__} {x} {y}"

    got = [r.value for r in run.map_cells(df, kinds, T.StringType(), ["x", "y"]).orderBy("tr_start").collect()]
    assert got == [f"int {big} nan", "NoneType None None", "int 5 1.0"]
    same = run.map_cells(df.drop("y"), lambda clone_num, time_range, x: x, T.LongType(), ["x"]).orderBy("tr_start").collect()
    assert [(r.value, r.failed) for r in same] == [(big, False), (None, False), (5, False)]
    folded = run.fold_history(
        df.drop("y"), lambda s, r: (s + 1, r["x"]), lambda: 0, T.LongType(), ["full_name"], ["tr_start"]
    ).orderBy("tr_start").collect()
    assert [(r.x, r.value) for r in folded] == [(big, big), (None, None), (5, 5)]

    def pieces(clone_num, time_range, x):
        yield x
        if x is None:
            raise ValueError("no x")

    out = run.map_chunks(df.drop("y"), pieces, T.LongType(), ["x"], ["full_name", "tr_start"]).orderBy("tr_start", "chunk_num").collect()
    assert [(r.value, r.failed) for r in out] == [(big, False), (None, False), (None, True), (5, False)]


def test_vectorized_cells_keep_longs(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, big, "a"), (2, None, None)], "k int, n long, s string").coalesce(1)
    out = run.map_cells_vectorized(df, lambda pdf: pdf["n"] * 2 + 1, T.LongType())
    assert sorted(map(tuple, out.collect())) == [(1, big, "a", 2 * big + 1), (2, None, None, None)]
    halves = run.map_cells_vectorized(df, lambda pdf: pdf["s"].fillna("z") + "!", T.StringType())
    assert sorted(r.value for r in halves.collect()) == ["a!", "z!"]


def test_failures_along_a_chain(spark):
    """More rounds than are kept apart, a shortcut, and a cycle."""
    edges = [(f"d{i + 1}", "data", 1, f"d{i}") for i in range(20)] + [("d9", "data", 2, "d1"), ("d0", "more", 1, "d20"), ("x", "data", 1, "y")]
    df = spark.createDataFrame(edges, "doc_id string, attribute_name string, ord int, input_doc_id string")
    failed = spark.createDataFrame([("d0", "data"), ("d15", "data")], "doc_id string, attribute_name string")
    got = {(r.doc_id, r.attribute_name): r.level for r in graph.propagate_failures(df, failed).collect()}
    want = {("d0", "data"): 0, ("d15", "data"): 0, ("d0", "more"): 6} | {(f"d{i}", "data"): i for i in range(1, 9)}
    want |= {(f"d{i}", "data"): 2 + i - 9 for i in range(9, 15)} | {(f"d{i}", "data"): i - 15 for i in range(16, 21)}
    assert got == want


def test_chunks_from_sql_equal_chunks(spark):
    """Pieces, a failure after some pieces, a wrong type, and NULL keys, by SQL and by DataFrame."""

    def pieces(word):
        for i, c in enumerate(word or ""):
            if c == "!":
                raise ValueError("no more")
            yield 5 if c == "5" else c * (i + 1)

    df = spark.createDataFrame([(1, "abc"), (2, "x!y"), (3, "a5"), (None, "z"), (4, None)], "k int, word string")
    run.register_chunks(spark, "pieces_of", pieces, T.StringType(), ["word"], ["k"])
    got = spark.sql("SELECT * FROM pieces_of(TABLE({cells}))", cells=df)
    want = run.map_chunks(df, pieces, T.StringType(), ["word"], ["k"])
    assert got.columns == want.columns
    short = lambda d: sorted((repr(tuple(r)[:4]), r.stderr_output.split("\n")[-1]) for r in d.collect())
    assert short(got) == short(want) and len(short(got)) == 8
