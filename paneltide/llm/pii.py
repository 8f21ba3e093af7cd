"""Personal data by weak supervision (operator 3), DataFrame functions only.

Four strict patterns give the base spans, which always stay.  Looser patterns give more
candidates.  Labelers vote on every candidate (1, -1, or 0 for no opinion): its shape, a
gazetteer, the words before it, its digits and the signs around it.  Expectation
maximisation over the counts of vote patterns (a few hundred numbers, whatever the input)
estimates how reliable each labeler is and how likely each pattern is personal data; a
logistic span classifier is trained on these soft labels, from the votes and from what a span
and its neighbours look like, and decides, as one Spark expression, which looser candidates
are added.

A text may hold any number of matches: positions are running sums of lengths taken in blocks,
what stands around a match comes from the pieces next to it, and overlaps are found in one
sweep over sorted ends, so the work grows with the text and the matches, not their product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.binding import let
from paneltide.llm.common import cut_lineage, text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  They match what the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
# match, but never try a run twice: possessive, and begun only where a run begins or the
# last match ended, so a long run without a match costs linear time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms, by the kind they stand for.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# A cheap test that a text may hold a match at all.
MAY_HOLD = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.contains("at)") | t.contains("at]"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}
# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl be ch at eu us ca au jp cn in br mx example test".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)"
LOCAL_NETS = r"^(?:0|127|169\.254|255)\."
# Words before a span that speak for or against personal data.
CUES = {
    "email": r"e-?mail|mail|contact|write to|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|client|from|login",
    "card": r"card|visa|master|amex|account|karte|carte|tarjeta|konto",
    "phone": r"phone|call|tel|mobile|fax|contact|number|telefon|telefono",
}
AGAINST = r"version|isbn|issn|order|invoice|section|serial|part no|sku|build|release"
CONTEXT = 24

#: Right and wrong votes each labeler is imagined to have cast before.
TRUST = (8.0, 2.0)
EM_ROUNDS, FIT_ROUNDS, FIT_STEP, FIT_RIDGE = 40, 400, 0.5, 1e-3
THRESHOLD = 0.5
LABELERS = ("shape", "gazetteer", "context", "digits", "edges")
LOOKS = ("long", "numeric", "capital", "led", "closed")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of ASCII digits pass the Luhn test?"""

    def add(state: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return state + F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check a base match has to pass."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


#: Items of a block of a running fold; blocks of blocks are folded alike, ``LEVELS`` deep.
FOLD_BLOCK, LEVELS = 64, 3


def running_fold(items: Column, start: Column, join: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """All prefix folds of an array, each with the item itself.

    Appending to an array copies it, so only blocks of ``FOLD_BLOCK`` are built that way; every
    block begins with the fold of the blocks before it.
    """

    def of(block: Column, before: Column) -> Column:
        none = F.array(before)
        made = F.aggregate(block, none, lambda out, x: F.array_append(out, join(F.element_at(out, -1), x)))
        return F.slice(made, 2, F.size(block))

    def cut(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / FOLD_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))
        return F.when(F.size(whole) > 0, blocks).otherwise(F.array(F.slice(whole, 1, 0)))

    def folded(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, start, join))
        return let(
            running_fold(sums, start, join, levels - 1),
            lambda total: F.flatten(F.transform(blocks, lambda block, i: of(block, F.coalesce(F.get(total, i - 1), start)))),
        )

    # Everything that a lambda reads more than once is named first, or each item would make it anew.
    return let(items, lambda whole: let(cut(whole), folded)) if levels else let(items, lambda whole: of(whole, start))


def _matches(text: Column, pattern: str) -> Column:
    """``start, end, match, before, left, right`` of all matches, leftmost first: code points, end exclusive.

    The text between matches comes from a split by the same pattern, so positions are running
    sums of lengths.  ``before`` ends what stands between the match and the beginning of the one
    before; ``left`` and ``right`` are the characters next to it, empty at the text's ends.
    """

    def placed(parts: Column) -> Column:
        between, hits = parts["between"], parts["hits"]
        lengths = F.transform(hits, lambda h, k: F.length(F.get(between, k)) + F.length(h))

        def spans(ends: Column) -> Column:
            def span(h: Column, k: Column) -> Column:
                earlier, gap, after = F.coalesce(F.get(hits, k - 1), F.lit("")), F.get(between, k), F.get(between, k + 1)
                later = F.concat(F.substring(after, 1, 1), F.coalesce(F.substring(F.get(hits, k + 1), 1, 1), F.lit("")))
                lead = F.concat(earlier, gap)
                return F.struct(
                    (F.get(ends, k) - F.length(h)).alias("start"), F.get(ends, k).alias("end"), h.alias("match"),
                    F.substring(lead, -CONTEXT, CONTEXT).alias("before"), F.substring(lead, -1, 1).alias("left"),
                    F.substring(later, 1, 1).alias("right"),
                )

            return F.transform(hits, span)

        return let(running_fold(lengths, F.lit(0), lambda a, x: a + x), spans)

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(parts, placed)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, base: bool, span: Column, domains: Sequence[str], calling_codes: Sequence[str]) -> Column:
    """The labelers' votes on one candidate."""
    match, digits, before = span["match"], _digits(span["match"]), F.lower(span["before"])
    around = F.concat(span["left"], span["right"])
    no = F.lit(False)
    listed = {
        "email": lambda: _vote(F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(list(domains)), match.rlike(r"[0-9-]$")),
        "ip": lambda: _vote(~match.rlike(LOCAL_NETS), match.rlike(LOCAL_NETS)),
        "card": lambda: _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": lambda: _vote(match.rlike(rf"^\+(?:{'|'.join(calling_codes)})[^0-9]*[0-9]|^\([2-9]|^[2-9]"), match.rlike(r"^\+0|^\(?[01]")),
    }[kind]()
    return F.struct(
        _vote(F.lit(base), F.lit(not base) & match.rlike(r"\s\s|[\[(]dot")).alias("shape"),
        listed.alias("gazetteer"),
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)).alias("context"),
        (_vote(F.length(digits) >= 7, digits.rlike(r"^(.)\1*$")) if kind in ("card", "phone") else _vote(no, no)).alias("digits"),
        _vote(~around.rlike(r"[\p{L}0-9_]"), around.rlike(r"[\p{L}0-9_]{2}")).alias("edges"),
    )


def _looks(span: Column) -> Column:
    """What the classifier sees of a span besides its votes: 0 or 1 each."""
    match = span["match"]
    seen = {
        "long": F.length(match) > 16,
        "numeric": 2 * F.length(_digits(match)) > F.length(match),
        "capital": match.rlike("[A-Z]"),
        "led": span["left"].rlike(r"^[\s:=<(]?$"),
        "closed": span["right"].rlike(r"^[\s,;.>)]?$"),
    }
    return F.struct(*[c.cast("int").alias(name) for name, c in seen.items()])


def _of_kind(kind: str, base: bool, text: Column, domains: Sequence[str], calling_codes: Sequence[str]) -> Column:
    """Valid candidates of one kind and form with their votes."""
    pattern = BASE[kind] if base else LOOSE[kind]

    def row(span: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            F.lit(base).alias("base"), _votes(kind, base, span, domains, calling_codes).alias("votes"), _looks(span).alias("looks"),
        )

    found = _matches(text, pattern)
    if base and kind != "email":
        found = F.filter(found, lambda s: valid(kind, s["match"]))
    votes, looks = ("struct<" + ",".join(f"{name}:int" for name in names) + ">" for names in (LABELERS, LOOKS))
    none = F.array().cast(f"array<struct<kind:int,start:int,end:int,base:boolean,votes:{votes},looks:{looks}>>")
    return F.when(MAY_HOLD[kind, base](text), F.transform(found, row)).otherwise(none)


def candidates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domains: Sequence[str] = DOMAINS,
    calling_codes: Sequence[str] = CALLING_CODES,
) -> DataFrame:
    """``doc_id, spans``: base and looser candidates of every whole text."""

    def all_forms(text: Column) -> Column:
        forms = [(k, True) for k in KINDS] + [(k, False) for k in LOOSE]
        return F.concat(*[_of_kind(k, base, text, domains, calling_codes) for k, base in forms])

    return docs.select(F.col(id_col).alias("doc_id"), let(text_of(F.col(text_col)), all_forms).alias("spans"))


Counts = list[tuple[tuple, float]]


def _pattern_counts(found: DataFrame) -> tuple[Counts, Counts]:
    """How often each (kind, votes) occurs, and each (kind, votes, looks).

    There are at most 4 * 3**5 * 2**5 rows, counted map-side first.
    """
    names = [*LABELERS, *LOOKS]
    one = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes.*", "s.looks.*")
    rows = one.groupBy("kind", *names).count().orderBy("kind", *names).collect()
    seen = [((r["kind"], *[r[name] for name in names]), float(r["count"])) for r in rows]
    votes: dict[tuple, float] = {}
    for key, n in seen:
        short = key[: 1 + len(LABELERS)]
        votes[short] = votes.get(short, 0.0) + n
    return list(votes.items()), seen


def estimate(counts: list[tuple[tuple, float]]) -> dict[tuple, float]:
    """Probability, per vote pattern, that a span is personal data (expectation maximisation).

    Given the truth, labelers vote independently, each with its own chance to be right on
    either side; no opinion is no evidence.  ``TRUST`` gives every labeler a few imagined
    votes, mostly right, so that the two sides cannot be exchanged.  It begins with the
    majority of the votes.
    """
    truth = {key: 1 / (1 + math.exp(-float(sum(key[1:])))) for key, _ in counts}
    for _ in range(EM_ROUNDS):
        total = sum(n for _, n in counts)
        prior = (sum(truth[k] * n for k, n in counts) + 1) / (total + 2)
        chance: dict[tuple, float] = {}
        for i in range(len(LABELERS)):
            for side in (0, 1):
                right, wrong = (1, -1) if side else (-1, 1)
                weight = {right: TRUST[0], wrong: TRUST[1]}
                for key, n in counts:
                    if key[1 + i]:
                        weight[key[1 + i]] += n * (truth[key] if side else 1 - truth[key])
                for v, w in weight.items():
                    chance[i, side, v] = w / (weight[right] + weight[wrong])
        for key, _ in counts:
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(chance[i, 1, v] / chance[i, 0, v]) for i, v in enumerate(key[1:]) if v)
            truth[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth


def _features(key: tuple) -> list[float]:
    return [1.0, *[1.0 if key[0] == k else 0.0 for k in range(len(KINDS))], *map(float, key[1:])]


def fit_classifier(counts: Counts, truth: dict[tuple, float]) -> list[float]:
    """Weights of a logistic classifier of spans, trained on the soft labels, weighted by counts."""
    weights = np.zeros(1 + len(KINDS) + len(LABELERS) + len(LOOKS))
    if not counts:
        return weights.tolist()
    x = np.array([_features(key) for key, _ in counts])
    n = np.array([n for _, n in counts])
    y = np.array([truth[key[: 1 + len(LABELERS)]] for key, _ in counts])
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights = weights - FIT_STEP * (FIT_RIDGE * weights + x.T @ ((p - y) * n) / n.sum())
    return weights.tolist()


def _score(span: Column, weights: list[float]) -> Column:
    total = F.lit(weights[0])
    for i in range(len(KINDS)):
        total = total + F.when(span["kind"] == i, F.lit(weights[1 + i])).otherwise(F.lit(0.0))
    for i, (group, name) in enumerate([*[("votes", n) for n in LABELERS], *[("looks", n) for n in LOOKS]]):
        total = total + span[group][name] * F.lit(weights[1 + len(KINDS) + i])
    return 1 / (1 + F.exp(-total))


def _apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, in one sweep.

    Others that begin before a span ends come before it in the sorted line; it overlaps one of
    them if the largest of their ends lies behind its start.
    """

    def line(both: Column) -> Column:
        spans, others = both["spans"], both["others"]
        of = F.transform(others, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("rank"), b["end"].alias("reach"), F.lit(None).cast("int").alias("i")))
        own = F.transform(spans, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("reach"), i.alias("i")))

        def swept(line: Column) -> Column:
            return let(
                running_fold(F.transform(line, lambda e: e["reach"]), F.lit(0), lambda a, x: F.greatest(a, x)),
                lambda most: F.filter(
                    F.transform(line, lambda e, k: F.when(F.get(most, k) <= F.get(spans, e["i"])["start"], F.get(spans, e["i"]))), lambda s: s.isNotNull()
                ),
            )

        return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.array_sort(F.concat(of, own)), swept)).otherwise(spans)

    return let(F.struct(spans.alias("spans"), others.alias("others")), line)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, domains: Sequence[str] = DOMAINS,
    calling_codes: Sequence[str] = CALLING_CODES,
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row.

    Counts and hash are those of the base spans; ``spans`` has the added ones too.  An added
    span never overlaps a base span, nor a span chosen of a kind before its own.  ``domains`` and
    ``calling_codes`` are the gazetteers.  NULL and empty texts have no spans; NULL ids pass
    through; repeated rows are searched each; an empty table gives no rows (and no candidates
    to learn from: nothing is added); further columns are ignored.
    """
    found = cut_lineage(candidates(docs, id_col, text_col, domains, calling_codes))
    votes, seen = _pattern_counts(found)
    weights = fit_classifier(seen, estimate(votes))

    def of_kind(number: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == number

    def order(spans: Column) -> Column:
        return F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

    base = F.filter("spans", lambda s: s["base"])
    likely = F.filter("spans", lambda s: ~s["base"] & (_score(s, weights) > threshold))
    rows = found.withColumns({"base_spans": base, "likely": likely}).withColumn("chosen", _apart(F.col("likely"), F.col("base_spans")))
    loose = sorted(KINDS.index(k) for k in LOOSE)
    for k in loose:
        rows = rows.withColumn(f"chosen_{k}", F.filter("chosen", of_kind(k)))
    added = [F.col(f"chosen_{loose[0]}")]
    for at, k in enumerate(loose[1:], 1):
        added.append(_apart(F.col(f"chosen_{k}"), F.concat(*[F.col(f"chosen_{x}") for x in loose[:at]])))
    rows = rows.withColumn("added", F.concat(*added))
    return rows.select(
        "doc_id",
        *[
            F.size(F.filter("base_spans", of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)
        ],
        F.sha2(_listed(order(F.col("base_spans"))), 256).alias("base_sha256"),
        _listed(order(F.concat("base_spans", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
