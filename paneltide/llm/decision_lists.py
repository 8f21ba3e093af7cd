"""Learned decision lists over text statistics (operator 10), DataFrame functions only.

Sequential covering: a rule is grown by adding, one at a time, the threshold condition
with the best information gain on one half of the labelled rows, then pruned on the other
half; rows it covers are taken away and the next rule is grown.  The list that results is
read from the top: the first rule that holds rejects the document, otherwise it is kept.
It is emitted as one conditional Spark expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.binding import let
from paneltide.llm.common import cut_lineage, text_of

#: Words of a window whose repetition is counted.
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Labelled documents used for learning (a bounded sample, chosen by the hash of the id).
LABELLED = 20_000
#: Cut points per statistic, conditions per rule, rules, and what a rule has to reach on the
#: rows it was not grown on: correct share and number of covered rejects.
CUTS, CONDITIONS, RULES, PRECISION, SUPPORT = 24, 4, 8, 0.97, 5

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the rules may test.
FEATURES = (
    "n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "digit_share",
    "upper_share", "stops_per_word", "words_per_line",
)


def _dropped(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words occurring twice or more in the text."""
    none = F.lit(0).cast("long")

    def same(pairs: Column, k: Column, pair: Column) -> Column:
        return F.coalesce(F.get(pairs, k)["h"] == pair["h"], F.lit(False))

    def places(pairs: Column) -> Column:
        # Pairs (hash, place) are sorted: a window is repeated if a neighbour has its hash.
        twice = F.filter(pairs, lambda p, k: same(pairs, k - 1, p) | same(pairs, k + 1, p))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def width(at: Column) -> Column:
        # Each window adds its words up to where the next repeated window begins.
        adds = F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(adds, none, lambda total, n: total + n)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(pairs, places), width)

    def from_hashes(hashes: Column) -> Column:
        # Most texts repeat nothing: one hash set decides that.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(covered(hashes))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, none).otherwise(let(windows, from_hashes))


def statistics(text: Column) -> Column:
    """A struct of all statistics of a whole text; NULL counts as empty, and gives zeros."""

    def of_parts(parts: Column) -> Column:
        t, words, lines = parts["t"], parts["words"], parts["lines"]
        n = F.size(words).cast("double")
        n_lines = F.size(lines)
        dup = (n_lines - F.size(F.array_distinct(lines))).cast("long")
        symbols, chars = _dropped(t, SYMBOLS), F.length(F.translate(t, SPACE, "")).cast("long")
        per = F.greatest(n, F.lit(1.0))

        def named(repeats: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
                dup.alias("n_dup_lines"), repeats.alias("n_repeat_words"),
                (chars / per).alias("mean_word"), (symbols / per).alias("symbols_per_word"),
                (dup / F.greatest(n_lines, F.lit(1))).alias("dup_line_share"), (repeats / per).alias("repeat_share"),
                (F.size(F.array_distinct(words)) / per).alias("distinct_share"),
                (_dropped(t, "0123456789") / F.greatest(chars, F.lit(1))).alias("digit_share"),
                (_dropped(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / F.greatest(chars, F.lit(1))).alias("upper_share"),
                (_dropped(t, ".!?") / per).alias("stops_per_word"), (n / F.greatest(n_lines, F.lit(1))).alias("words_per_line"),
            )

        return let(_repeated(words), named)

    t = text_of(text)
    trimmed = F.btrim(t, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return let(F.struct(t.alias("t"), words.alias("words"), lines.alias("lines")), of_parts)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def _all(conditions: tuple[Condition, ...], stats: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.column(stats) for c in conditions], F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``stats, reject, grow`` of at most about ``limit`` labelled documents, checkpointed.

    The sample is taken by the hash of the id; it is small, so it goes to the documents and
    only their texts are looked at.  Rows with a NULL id or label teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    share = min(1.0, limit / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("label")), F.lit(1 << 30))
    chosen = known.where(place < int(share * (1 << 30))).groupBy(F.col(id_col).alias("id_")).agg(
        (F.min(label_col) == 0).alias("reject")
    )
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(chosen), "id_")
    grow = F.pmod(F.xxhash64(F.col("id_"), F.lit("grow")), F.lit(3)) > 0
    return cut_lineage(rows.select(statistics(F.col("text_")).alias("stats"), "reject", grow.alias("grow")))


def _candidates(rows: DataFrame, condition: Column, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per statistic, rejects and kept rows between neighbouring cut points: a few hundred numbers."""
    got = (
        rows.where(condition).select("reject", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin")
        .agg(F.count_if("reject").alias("p"), F.count_if(~F.col("reject")).alias("n")).collect()
    )
    names = list(cuts)
    out = {f: [(0, 0)] * (len(points) + 1) for f, points in cuts.items()}
    for r in got:
        out[names[r["feature"]]][r["bin"]] = (r["p"], r["n"])
    return out


def _binned(sample: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """The sample with the interval each statistic lies in, in the order of ``cuts``; checkpointed."""

    def interval(value: Column, points: list[float]) -> Column:
        return F.size(F.filter(F.lit(points).cast("array<double>"), lambda c: value > c))

    bins = [interval(F.col("stats")[f], points) for f, points in cuts.items()]
    # A few thousand narrow rows: two tasks are enough for the many small jobs over them.
    return cut_lineage(sample.withColumn("bins", F.array(*bins)).coalesce(2))


def _best(binned: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition with the highest information gain (ties: the first by name and cut)."""
    best: tuple[float, Condition | None] = (0.0, None)
    for feature in sorted(binned):
        bins = binned[feature]
        p0, n0 = sum(b[0] for b in bins), sum(b[1] for b in bins)
        if not p0:
            return best
        before = math.log2(p0 / (p0 + n0))
        p = n = 0
        for cut, (bp, bn) in zip(cuts[feature], bins):
            p, n = p + bp, n + bn
            for above, cp, cn in ((False, p, n), (True, p0 - p, n0 - n)):
                if cp:
                    gain = cp * (math.log2(cp / (cp + cn)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, cut))
    return best


def learn_rules(sample: DataFrame) -> list[tuple[Condition, ...]]:
    """Rules that reject, in the order found; none without rejects to learn from."""
    stats = F.col("stats")
    points = [i / CUTS for i in range(1, CUTS)]
    asked = sample.agg(*[F.percentile_approx(stats[f].cast("double"), points, 2000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(asked[f])) for f in FEATURES if asked[f]}
    if not cuts:
        return []
    # Cuts among the rejects alone find rare kinds that cuts over all rows miss.
    rare = sample.where("reject").agg(
        *[F.percentile_approx(stats[f].cast("double"), points, 2000).alias(f) for f in FEATURES]
    ).first()
    cuts = {f: sorted({*c, *(rare[f] or [])}) for f, c in cuts.items()}
    sample = _binned(sample, cuts)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < RULES:
        taken = reduce(lambda a, b: a | b, [_all(r, stats) for r in rules], F.lit(False))
        left = sample.where(~taken)
        growing, held = left.where("grow"), left.where("not grow")
        rule: tuple[Condition, ...] = ()
        while len(rule) < CONDITIONS:
            binned = _candidates(growing, _all(rule, stats), cuts)
            if sum(b[1] for b in next(iter(binned.values()))) == 0:
                break
            _, condition = _best(binned, cuts)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        # Prune: the shortest head of the rule with the best (p - n) / (p + n) on held rows.
        tries = [rule[:k] for k in range(1, len(rule) + 1)]
        sums = [f(_all(t, stats) & r).alias(f"{c}{k}") for k, t in enumerate(tries) for c, f, r in (
            ("p", F.count_if, F.col("reject")), ("n", F.count_if, ~F.col("reject")))]
        got = held.agg(*sums).first()
        scored = [(got[f"p{k}"], got[f"n{k}"]) for k in range(len(tries))]
        k = max(range(len(tries)), key=lambda k: ((scored[k][0] - scored[k][1]) / max(1, sum(scored[k])), -k))
        p, n = scored[k]
        if p < SUPPORT or p / (p + n) < PRECISION:
            break
        rules.append(tries[k])
    return rules


def rule_column(rules: list[tuple[Condition, ...]], stats: Column) -> Column:
    """Number of the first rule that holds (from 1), 0 if none does."""
    out = F.lit(0)
    for number in range(len(rules), 0, -1):
        out = F.when(_all(rules[number - 1], stats), F.lit(number)).otherwise(out)
    return out


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])


def judge_documents(
    docs: DataFrame, labels: DataFrame, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``kept`` and ``rule`` of every row.

    ``labels`` has ``doc_id`` and a label, 0 for documents to reject.  NULL texts have no
    words and fail the base rule, as do empty ones; NULL ids pass through; repeated rows
    are judged each; without usable labels no rule is learned and the base rule decides;
    an empty table gives no rows; further columns are ignored.
    """
    rules = learn_rules(labelled_sample(docs, labels, limit, id_col, text_col, label_col))
    # Exploding a one-element array keeps the struct as a value; it is not inlined into its uses.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(statistics(F.col(text_col)))).alias("s"))
    s = F.col("s")
    rule = rule_column(rules, s)
    return rows.select(
        "doc_id", *[s[c].alias(c) for c in BASE], base_failed(s).alias("base_failed"),
        (~base_failed(s) & (rule == 0)).alias("kept"), rule.alias("rule"),
    )
