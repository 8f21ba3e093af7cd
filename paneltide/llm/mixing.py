"""Mixing sources to target weights by iterative proportional fitting (operator 2).

Documents are counted into cells (source x language x topic).  Categories without a target
of their own share one cell name, so there are at most as many cells as the target lists
multiply to, whatever the input; that small table is raked on the driver: cell weights are
scaled to each marginal in turn, never above what a cell has, until all marginals fit.  A
document's probability is its cell's raked weight over the cell's tokens, and a hash of its
id against that probability decides, so a repeated run chooses the same documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm.common import cut_lineage, free_name, text_of, word_count

#: Stands for every category without a target, NULL among them.
OTHER = "*"
ROUNDS, CLOSE = 500, 1e-9
SEED = "mix"

Targets = Mapping[str, Mapping[str, float]]


def form_of(text: Column) -> Column:
    """A document's topic by its form, as no topic column is given: a rule over the whole text."""
    t = text_of(text)
    n = F.greatest(F.length(t), F.lit(1))

    def share(characters: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, characters, ""))) / n

    return (
        F.when(share("#*$%&<>") > 0.03, "symbols").when(t.contains(" | "), "table").when(share("0123456789") > 0.03, "figures")
        .when(n < 1000, "note").when(n < 8000, "article").otherwise("book")
    )


def _category(c: Column, target: Mapping[str, float]) -> Column:
    named = [k for k in target if k != OTHER]
    return F.when(c.isin(named), c).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rake(cells: dict[tuple[str, ...], float], targets: list[Mapping[str, float]], budget: float) -> dict[tuple[str, ...], float]:
    """Weights of cells that sum to ``budget`` and fit the marginals, none above its tokens.

    A target is relative to the others of its dimension; a category without tokens gives its
    share to the rest; ``*`` without a target keeps its natural share.  If the limits leave no
    solution, the last round's weights are returned: dimensions raked last fit best.
    """
    total = sum(cells.values())
    if total <= 0:
        return dict.fromkeys(cells, 0.0)
    wanted = []
    for d, target in enumerate(targets):
        have: dict[str, float] = {}
        for key, tokens in cells.items():
            have[key[d]] = have.get(key[d], 0.0) + tokens
        share = {k: target[k] for k, v in have.items() if v > 0 and k in target}
        natural = have.get(OTHER, 0.0) / total if OTHER not in target else 0.0
        scale = (1 - natural) / sum(share.values()) if sum(share.values()) > 0 else 0.0
        share = {k: v * scale for k, v in share.items()}
        if natural:
            share[OTHER] = natural if scale else 1.0
        wanted.append({k: budget * v for k, v in share.items()})
    weights = {k: v * budget / total for k, v in cells.items()}
    for _ in range(ROUNDS):
        worst = 0.0
        for d, want in enumerate(wanted):
            now = dict.fromkeys(want, 0.0)
            for key, w in weights.items():
                now[key[d]] = now.get(key[d], 0.0) + w
            for key, w in weights.items():
                goal, have = want.get(key[d], 0.0), now[key[d]]
                if have > 0:
                    worst = max(worst, abs(goal - have) / budget)
                    weights[key] = min(cells[key], w * goal / have)
        if worst < CLOSE:
            break
    return weights


def _with_cells(docs: DataFrame, targets: Targets, source: Column, lang: Column, topic: Column, text_col: str, name: str) -> DataFrame:
    of = {"source": source, "lang": lang, "topic": topic}
    cell = F.struct(*[_category(of[d], targets[d]).alias(d) for d in ("source", "lang", "topic")])
    return docs.withColumn(name, F.struct(cell.alias("cell"), topic.alias("topic"), word_count(F.col(text_col)).alias("tokens")))


def _chosen(
    docs: DataFrame, targets: Targets, share: float, id_col: str, text_col: str, source_col: str, lang_col: str,
    topic: Column | None, name: str, narrow: bool = False,
) -> DataFrame:
    """``docs`` (when ``narrow``, without its texts) with a struct ``name``: topic, tokens, probability, kept."""
    topic = form_of(F.col(text_col)) if topic is None else topic
    marked = _with_cells(docs, targets, F.col(source_col), F.col(lang_col), topic, text_col, name)
    if narrow:
        # Topics and words are read from the texts once, and written without them.
        marked = cut_lineage(marked.drop(text_col))
    info = F.col(name)
    counted = marked.groupBy(info["cell"]["source"].alias("s"), info["cell"]["lang"].alias("l"), info["cell"]["topic"].alias("t")).agg(
        F.sum(info["tokens"]).alias("n")
    )
    cells = {(r["s"], r["l"], r["t"]): float(r["n"]) for r in counted.collect()}
    weights = rake(cells, [targets[d] for d in ("source", "lang", "topic")], share * sum(cells.values()))
    rows = [(s, l, t, weights[s, l, t] / n if n else 0.0) for (s, l, t), n in sorted(cells.items())]
    table = docs.sparkSession.createDataFrame(rows, "s string, l string, t string, p double")
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(SEED)), 11).cast("double") / float(1 << 53)
    p, of_cell = free_name(marked, "p_"), free_name(marked, "cell_")
    # As many rows as there are cells, see above: bounded by the targets.
    cell_of = F.broadcast(
        table.select(F.struct(F.col("s").alias("source"), F.col("l").alias("lang"), F.col("t").alias("topic")).alias(of_cell), F.col("p").alias(p))
    )
    joined = marked.join(cell_of, info["cell"] == F.col(of_cell), "left")
    chance = F.coalesce(F.col(p), F.lit(0.0))
    decided = F.struct(
        info["topic"].alias("topic"), info["tokens"].alias("tokens"), chance.alias("probability"), (u < chance).alias("kept")
    )
    return joined.withColumn(name, decided).select(*[c for c in docs.columns if c in marked.columns], name)


def mix_weights(
    docs: DataFrame, targets: Targets, share: float, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, probability, kept`` of every row.

    ``targets`` has a mapping of relative weights each for source, lang and topic; ``share``
    is the part of all tokens (words) to keep.  NULL sources and languages count as having
    no target; NULL and empty texts have no tokens and take their cell's probability (0 in
    a cell without tokens); NULL ids share one hash; rows that repeat an id share their
    hash; an empty table gives no rows; further columns are ignored.
    """
    columns = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"), (form_of(F.col(text_col)) if topic is None else topic).alias("topic"),
    )
    got = _chosen(columns, targets, share, "doc_id", "text", "source", "lang", F.col("topic"), "mix", narrow=True)
    return got.select("doc_id", "source", "lang", "topic", F.col("mix.tokens"), F.col("mix.probability"), F.col("mix.kept"))


def mix_documents(
    docs: DataFrame, targets: Targets, share: float, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """The chosen documents, with the columns of ``docs``; rules as in ``mix_weights``."""
    name = free_name(docs, "mix_")
    got = _chosen(docs, targets, share, id_col, text_col, source_col, lang_col, topic, name)
    return got.where(F.col(name)["kept"]).select(*docs.columns)
