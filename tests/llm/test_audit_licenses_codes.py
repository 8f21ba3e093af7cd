"""Operators 11 to 13 against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import filter_audit, licenses, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_brute(rows, labels):
    """Rows are (doc_id, text, lang); labels (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if i is not None and least[t] < i:
            f.add("E")
        failing.append((i, lang or "", f))
    out, first = collections.defaultdict(lambda: [0] * 6), collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for i, part, f in failing:
            gone = False
            for step, x in enumerate(order, 1):
                o = out[part, order, step]
                if x in f and not gone:
                    o[1] += 1
                    o[4] += i in good
                    o[5] += i in toxic
                    first[part, x] += 1
                    gone = True
                elif x in f:
                    o[2] += 1
                o[0] += not gone
                o[3] += f == {x}
    return {(*k, *v, first[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    long = [" ".join(f"w{rng.randrange(500)}" for _ in range(140)) for _ in range(5)]
    pool = long + ["short", "SHOUT NOW", "a # b", "é É ü", "", None, "x " * 200, long[0] + " |"]
    # Ids fall within and across files, so that smaller ones arrive late and retract.
    rows = [(200 - i, rng.choice(pool), rng.choice(["en", "de", "", None])) for i in range(160)]
    rows += [rows[4], rows[4], (None, "short", "en"), (None, long[0], None), (100, "other text of a used id", "en")]
    return rows


@pytest.mark.parametrize("batches", [1, 3, 100])
def test_filter_audit(spark, tmp_path, batches):
    rows = audit_rows()
    labels = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 200, 2)] + [(4, 1, None), (None, 1, 1), (5, None, 1), (6, 1, 1), (6, 0, 0)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, part string, mask int, digest string")
    path = f"{tmp_path}/documents.parquet"
    df.coalesce(1).write.option("maxRecordsPerFile", 23).parquet(path)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(spark, path, known, batches)
    assert {tuple(r) for r in got.collect()} == audit_brute(rows, labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_filter_audit_retracts(spark, tmp_path):
    """The smallest id of a text comes last: every earlier holder is taken back."""
    path = f"{tmp_path}/documents.parquet"
    df = spark.createDataFrame([(10 - i, "same", "en") for i in range(9)], "doc_id long, text string, lang string")
    df.coalesce(1).write.option("maxRecordsPerFile", 1).parquet(path)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {(r["mask"], r.n) for r in filter_audit.mask_counts(spark, path, none, batches=9).collect()}
    assert counts == {(1, 1), (1 | filter_audit.TWICE, 8)}


def test_filter_audit_without_rows(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    assert filter_audit.audit_filters(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "  \n", "cc by", "CC-BY and cc by\tCC.BY", "ccby cc bye", "All rights reserved. all RIGHTS\n\nreserved", "GNU General Public License, version 3",
    "the general public license general public license", "écc by cc by cc byé", "cc cc by by", "x" * 5000 + " all rights reserved " * 3000,
    "Licensed under CC BY-NC 4.0.", "\U0001f600 cc\x85by All rights reserved", "-- cc by --",
]


def test_license_scan(spark):
    rows = [(i, t, "z", 7) for i, t in enumerate(TEXTS)] + [(None, "cc by", "z", 7), (3, "cc by", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")
    got = licenses.scan_licenses(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((i, *license_brute(t)) for i, t, *_ in rows), key=repr)
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT", "mit", 0.2), ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nx", "apache,gpl,mit", 0.25),
        ("SPDX-License-Identifier: MIT OR GPL-2.0-only AND Apache-2.0", "apache,gpl,mit", 0.2),
        ("SPDX-License-Identifier: GPL-3.0-or-later WITH Classpath-exception-2.0", "gpl", 0.5), ("licensed under MIT or", "mit", 0.2),
        ("SPDX-License-Identifier: ((MIT AND (GPL-2.0", "gpl,mit", 0.75), ("licensed under MIT OR ((", "mit", 0.2), ("licensed under (", "", 0.0),
        ("licensed under MIT WITH (", "mit", 0.2), ("licensed under MIT) AND GPL-2.0", "gpl,mit", 0.75), ("licensed under the Apache License", "apache", 0.25),
        ("licensed under GPL-2.0+ OR BSD-3-Clause. All rights reserved", "bsd,gpl,reserved", 1.0), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 0.9),
        ("GNU Lesser General Public License", "gpl,lgpl", 0.75), ("the mit way", "", 0.0),
    ],
)
def test_license_expressions(text, labels, score):
    out = licenses.scan(text, licenses.automaton(licenses.BASE, licenses.NOTICES, licenses.TAGS))
    assert out[5] == labels and out[6] == pytest.approx(score)


def codes_brute(rows, parts=8, entries=16, rounds=6):
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[tuple(r[1][p * width : (p + 1) * width]) for p in range(parts)] for r in kept]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, near) if n[p][1] == j]
                if own:
                    books[p][j] = tuple(sum(x) // len(own) for x in zip(*own))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    near = assign()
    errors = [sum(d for d, _ in n) for n in near]
    by = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        by[label] += e
    return [(r[0], "".join(f"{j:02x}" for _, j in n), e, by[r[2]], digest) for r, n, e in zip(kept, near, errors)]


SCHEMA = "vec_id long, embedding array<float>, label int, rid int, part int, code string"


@pytest.mark.parametrize(("width", "block"), [(16, 3), (16, 256), (8, 5), (24, 16)])
def test_vector_codes(spark, width, block):
    rng = random.Random(width + block)
    grid = lambda: [rng.randint(-4, 4) / 8 for _ in range(width)]  # noqa: E731  coarse values make ties
    rows = [(i, grid(), rng.choice([1, 2, None])) for i in range(120)]
    rows += [(500 + i, rows[0][1], 1) for i in range(60)] + [rows[7], rows[7], (3, grid(), 2), (None, grid(), None), (None, rows[2][1], 2)]
    rows += [(900, None, 1), (-5, [None] * width, 1), (-6, [float("nan")] * width, 1), (-7, [float("-inf")] + [0.0] * (width - 1), 1), (901, [0.5], 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in vector_codes.encode_vectors(df, block_points=block).collect()]
    assert sorted(got, key=repr) == sorted(codes_brute(rows), key=repr)


def test_vector_codes_few_rows(spark):
    rows = [(i, [i / 4] * 8, None) for i in range(5)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA)
    assert sorted(map(tuple, vector_codes.encode_vectors(df).collect())) == sorted(codes_brute(rows))
    assert vector_codes.encode_vectors(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, [], 1, 1, 1, "c"), (2, [], 1, 1, 1, "c")], SCHEMA)
    assert {(r.code, r.error) for r in vector_codes.encode_vectors(none).collect()} == {("00" * 8, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 9, 1, 1, 1, "c")], SCHEMA))
    with pytest.raises(ValueError, match="too large"):
        vector_codes.encode_vectors(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e12)))


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points, entries = rng.integers(-9, 9, (20, 3)), rng.integers(-30, 30, (16, 3))
        index, error = vector_codes.nearest(points, entries, vector_codes.shortlist(points.min(0), points.max(0), entries))
        all_d = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (index == all_d.argmin(1)).all() and (error == all_d.min(1)).all()


def test_hilbert_keys_are_a_walk():
    """On a full grid, neighbours along the curve are neighbours in space."""
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    # Rounding to the finest level keeps the order of the grid's cells.
    keys = vector_codes.hilbert_keys(grid, np.array([0, 0]), np.array([7, 7]))
    assert len(set(keys.tolist())) == 64
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) <= 2).all()
