"""Quality by co-training (operator 9): two classifiers that teach each other.

One view is the content: hashed words and signs of the text.  The other is what a page
tells without its words: source, language, sizes, layout.  Each view's logistic
regression is trained on labelled documents; over some rounds each labels the documents
of an unlabelled pool that it is sure of, and the *other* view learns from them.  The pool is a
share of the corpus and grows with it; fits are distributed.  Each
view's score is then calibrated on labelled documents kept apart, and the calibrated
log-odds are added (less the prior, which both contain) to score every document.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.binding import let
from paneltide.llm.common import cut_lineage, text_of

#: Labelled documents used for fitting at most: a bounded sample, by id hash.
LABELLED = 8_000
#: The unlabelled pool: a share of all documents by their hash, and this many where the share is less.
POOL, POOL_SHARE = 6_000, 0.04
#: Sampled documents that one task of a fit holds.
ROWS_A_TASK = 8_000
ROUNDS, SURE = 2, 0.98
CONTENT_DIMS, META_DIMS = 1 << 13, 1 << 8
ITERATIONS, RIDGE, PSEUDO_WEIGHT = 15, 1e-3, 0.5
#: Documents whose probability of good quality is below are rejected.
REJECT_BELOW = 0.2

WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
META_NUMBERS = ("chars", "words", "lines", "word_length", "distinct", "signs", "digits", "upper", "stops")


def _views(text: Column) -> Column:
    """Tokens of the content view and numbers of the other, of a whole text."""

    def of_words(parts: Column) -> Column:
        t, words = parts["t"], parts["words"]
        n, chars = F.size(words).cast("double"), F.greatest(F.length(t), F.lit(1)).cast("double")

        def per(characters: str, of: Column) -> Column:
            return (F.length(t) - F.length(F.translate(t, characters, ""))) / of

        # A word's signs: capitals as X, digits as 9, small letters left out.
        signs = F.split(F.translate(t, UPPER + DIGITS + LOWER, "X" * 26 + "9" * 10), WHITE)
        return F.struct(
            F.concat(words, signs).alias("tokens"), F.log1p(chars).alias("chars"), F.log1p(n).alias("words"),
            F.log1p(F.regexp_count(t, F.lit("\n")).cast("double")).alias("lines"), (chars / n).alias("word_length"),
            (F.size(F.array_distinct(words)) / n).alias("distinct"), per("#*$%&|<>", n).alias("signs"),
            per(DIGITS, chars).alias("digits"), per(UPPER, chars).alias("upper"), per(".!?", n).alias("stops"),
        )

    t = text_of(text)
    return let(F.struct(t.alias("t"), F.split(F.lower(t), WHITE).alias("words")), of_words)


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """``doc_id, content, meta``: a vector of each view."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.explode(F.array(_views(F.col(text_col)))).alias("v"),
    ).select("doc_id", "source", "lang", "v.*")
    hashed = HashingTF(inputCol="tokens", outputCol="counts", numFeatures=CONTENT_DIMS).transform(rows)
    content = Normalizer(inputCol="counts", outputCol="content", p=1.0).transform(hashed)
    origin = FeatureHasher(inputCols=["source", "lang"], outputCol="origin", numFeatures=META_DIMS).transform(content)
    meta = VectorAssembler(inputCols=[*META_NUMBERS, "origin"], outputCol="meta").transform(origin)
    return meta.select("doc_id", "content", "meta")


def _margin(model: LogisticRegressionModel) -> Column:
    """The model's log-odds of good quality, from the column its prediction wrote."""
    return F.get(vector_to_array(F.col(model.getRawPredictionCol())), 1)


def _scored(rows: DataFrame, models: dict[str, LogisticRegressionModel]) -> DataFrame:
    """``rows`` with ``z_content`` and ``z_meta``."""
    for view, model in models.items():
        out = model.transform(rows)
        rows = out.withColumn(f"z_{view}", _margin(model)).select(*rows.columns, f"z_{view}")
    return rows


def _fit(view: str, rows: DataFrame) -> LogisticRegressionModel:
    learner = LogisticRegression(
        featuresCol=view, labelCol="label", weightCol="weight", maxIter=ITERATIONS, regParam=RIDGE,
        rawPredictionCol=f"raw_{view}", probabilityCol=f"p_{view}", predictionCol=f"y_{view}",
    )
    return learner.fit(rows.select(view, "label", "weight"))


def _platt(rows: list[tuple[float, float]]) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (log-odds, label), by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        g1 = g2 = 0.0
        h11 = h22 = 1e-3
        h12 = 0.0
        for z, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * z + b))))
            w = p * (1 - p)
            g1, g2 = g1 + (p - y) * z, g2 + (p - y)
            h11, h12, h22 = h11 + w * z * z, h12 + w * z, h22 + w
        det = h11 * h22 - h12 * h12
        if det <= 1e-12:
            break
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = max(0.05, a - step * da), b - step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return a, b


class CoTrained:
    """Both views' models, their calibration, and the prior log-odds of good quality."""

    def __init__(self, models: dict[str, LogisticRegressionModel], curves: dict[str, tuple[float, float]], prior: float):
        self.models, self.curves, self.prior = models, curves, prior

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows of ``features`` with ``p_content``, ``p_meta`` and the combined ``quality``."""

        def chance(z: Column) -> Column:
            return 1 / (1 + F.exp(-z))

        z = {v: F.col(f"z_{v}") * a + b for v, (a, b) in self.curves.items()}
        return _scored(rows, self.models).select(
            "doc_id", chance(z["content"]).alias("p_content"), chance(z["meta"]).alias("p_meta"),
            chance(z["content"] + z["meta"] - self.prior).alias("quality"),
        )


def _place(c: Column, salt: str) -> Column:
    """A uniform number of an id, between 0 and 1."""
    return F.shiftrightunsigned(F.xxhash64(c, F.lit(salt)), 11).cast("double") / float(1 << 53)


def co_train(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
    pool_share: float = POOL_SHARE,
) -> CoTrained | None:
    """Fit on at most about ``labelled`` labelled documents and a pool of further ones.

    The pool has ``pool_share`` of all documents, ``pool`` at least.  A labelled id counts once
    however many rows repeat it, and so does a pair of id and text in the pool.  None if the
    labelled documents do not have both classes: there is nothing to learn then.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    share = labelled / max(1, known.count())
    chosen = known.where(_place(F.col(id_col), "labelled") < share).groupBy(F.col(id_col).alias("chosen_")).agg(
        F.max(label_col).cast("double").alias("label")
    )
    # The pool takes documents by their hash, labelled ones among them without their labels.
    total = docs.count()
    taken = max(pool / max(1, total), pool_share)
    own_hash = F.xxhash64(text_of(F.col(text_col)))
    rows = docs.select(*dict.fromkeys([id_col, text_col, source_col, lang_col])).join(
        F.broadcast(chosen), F.col(id_col) == F.col("chosen_"), "left"
    )
    picked = rows.where(F.col("label").isNotNull() | (_place(F.struct(id_col, own_hash), "pool") < taken))
    once = picked.groupBy(F.col(id_col).alias("id_"), F.when(F.col("label").isNull(), own_hash).alias("of_text")).agg(
        F.min_by(F.struct(F.col(text_col).alias("t_"), F.col(source_col).alias("s_"), F.col(lang_col).alias("l_")), own_hash).alias("row_")
    )
    vectors = features(once.select("id_", "row_.*"), "id_", "t_", "s_", "l_").join(
        F.broadcast(chosen.withColumnRenamed("chosen_", "doc_id")), "doc_id", "left"
    )
    # The sample is read by many small jobs: few tasks serve it best.
    sample = cut_lineage(vectors.repartition(max(4, int((labelled + taken * total) / ROWS_A_TASK))))
    taught = sample.where("label IS NOT NULL")
    train = taught.where(_place(F.col("doc_id"), "fold") < 0.67).withColumn("weight", F.lit(1.0))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if not (sizes.get(0.0) and sizes.get(1.0)):
        return None
    apart = taught.where(_place(F.col("doc_id"), "fold") >= 0.67)
    unlabelled = sample.where("label IS NULL")
    models = {v: _fit(v, train) for v in ("content", "meta")}
    for _ in range(rounds):
        # The scores are written, so a round's labels stay what they were.
        sure = math.log(SURE / (1 - SURE))
        scored = cut_lineage(_scored(unlabelled, models))
        other = {"content": "meta", "meta": "content"}
        models = {
            view: _fit(
                view,
                train.select(view, "label", "weight").unionByName(
                    scored.where(F.abs(f"z_{other[view]}") > sure).select(
                        view, (F.col(f"z_{other[view]}") > 0).cast("double").alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight")
                    )
                ),
            )
            for view in models
        }
    held = [(r["z_content"], r["z_meta"], r["label"]) for r in _scored(apart, models).select("z_content", "z_meta", "label").collect()]
    good = sum(y for *_, y in held)
    prior = math.log((good + 1) / (len(held) - good + 1))
    curves = {"content": _platt([(a, y) for a, _, y in held]), "meta": _platt([(b, y) for _, b, y in held])}
    return CoTrained(models, curves, prior)


def score_documents(
    docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW, labelled: int = LABELLED, pool: int = POOL,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """``doc_id, p_content, p_meta, quality, kept`` of every row.

    ``labels`` has the id and 1 for good documents, 0 for others.  NULL texts count as empty
    and are scored like any text; NULL sources and languages are a value of their own; NULL
    ids pass through; repeated rows are scored each; if the labels do not have both classes
    the scores are NULL and all rows are kept; an empty table gives no rows; further columns
    are ignored.
    """
    model = co_train(docs, labels, labelled, pool, ROUNDS, id_col, text_col, source_col, lang_col, label_col)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(
            F.col(id_col).alias("doc_id"), none.alias("p_content"), none.alias("p_meta"), none.alias("quality"), F.lit(True).alias("kept")
        )
    scored = model.score(features(docs, id_col, text_col, source_col, lang_col))
    return scored.withColumn("kept", F.col("quality") >= reject_below)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``score_documents`` keeps, with the columns of ``docs``.

    Rows are matched by id and text, so that repeated ids with different texts keep apart.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col, lang_col = options.get("source_col", "source"), options.get("lang_col", "lang")
    model = co_train(docs, labels, **{k: v for k, v in options.items() if k != "reject_below"})
    if model is None:
        return docs
    # The whole row rides along as the id, so nothing is joined back.
    whole = docs.select(F.struct(*docs.columns).alias("row_"), F.col(text_col).alias("t_"), F.col(source_col).alias("s_"), F.col(lang_col).alias("l_"))
    scored = model.score(features(whole, "row_", "t_", "s_", "l_"))
    return scored.where(F.col("quality") >= options.get("reject_below", REJECT_BELOW)).select("doc_id.*")
