"""Walks over dependency and hierarchy edges.

Failures go out by frontiers: each round is one equi-join from the frontier to the edge
table, deduplicated with map-side combine, with as many rounds as the graph is deep.  Hierarchies
are walked by pointer doubling, whose rounds grow with the logarithm of the depth.  Every round's
result is kept in the shared folder: plans stay short and a lost executor costs no replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneltide.operators.ordered import Measure, global_position, in_slices, running
from paneltide.session import cut_lineage, written

# Fixed value: message of a consumer whose input failed.
UPSTREAM = "Upstream failure from "


#: Rounds after which the documents reached so far become one table again.
COLLAPSE = 8


def propagate_failures(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Attributes that fail, directly (level 0) or through an input at any distance.

    ``edges(doc_id, attribute_name, ord, input_doc_id)``, ``failed(doc_id,
    attribute_name)``.  The message names the first failing input and its attributes.
    """
    pair = ["doc_id", "attribute_name"]
    direct_pairs = cut_lineage(failed.select(*pair).distinct())
    # The walk goes over documents: a document that failed once has told all its consumers.
    links = cut_lineage(edges.select("input_doc_id", "doc_id").distinct())
    frontier = reached = direct_pairs.select("doc_id").distinct().withColumn("level", F.lit(0))
    level, parts = 0, 1
    while True:
        level += 1
        hit = links.join(frontier.select(F.col("doc_id").alias("input_doc_id")), "input_doc_id", "left_semi").select("doc_id").distinct()
        frontier = cut_lineage(hit.join(reached.select("doc_id"), "doc_id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        reached, parts = reached.unionByName(frontier), parts + 1
        if parts > COLLAPSE:
            reached, parts = cut_lineage(reached), 1
            # Links to documents that failed can tell nothing new.
            links = cut_lineage(links.join(reached.select("doc_id"), "doc_id", "left_anti"))
    told = reached.select(F.col("doc_id").alias("input_doc_id"), (F.col("level") + 1).alias("__level"))
    # One pass over the edges of failed inputs gives both the level and the first cause.
    caused = edges.join(told, "input_doc_id").groupBy(*pair).agg(
        F.min("__level").alias("level"), F.min_by("input_doc_id", "ord").alias("input_doc_id")
    )
    indirect = cut_lineage(caused.join(direct_pairs, pair, "left_anti"))
    lists = direct_pairs.unionByName(indirect.select(*pair)).groupBy("doc_id").agg(F.sort_array(F.collect_list("attribute_name")).alias("__atts"))
    told = indirect.join(lists.withColumnRenamed("doc_id", "input_doc_id"), "input_doc_id")
    quoted = F.array_join(F.transform("__atts", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    message = F.concat(F.lit(UPSTREAM), F.col("input_doc_id").cast("string"), F.lit(": ["), quoted, F.lit("]"))
    direct = direct_pairs.select(
        *pair, F.lit(0).alias("level"), F.lit(None).cast(told.schema["input_doc_id"].dataType).alias("input_doc_id"),
        F.lit(None).cast("string").alias("message"),
    )
    return direct.unionByName(told.select(*pair, "level", "input_doc_id", message.alias("message")))


def _lift(state: DataFrame, combine, grow=None) -> DataFrame:
    """Pointer doubling: ``up`` of every row jumps over twice the distance each round until it is NULL.

    ``combine`` merges a row (``r_``) with the one it points to (``a_``), ``grow`` names a column
    that a row hands to the one it points to.  Rounds grow with the logarithm of the longest
    chain; rows whose chain has no end keep their ``up``.
    """
    names = [c for c in state.columns if c not in ("node", "up")]
    waiting = None
    while True:
        left = state.where("up IS NOT NULL").count()
        if left == 0 or left == waiting:
            return state
        waiting = left
        active = state.where("up IS NOT NULL")
        above = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"a_{c}") for c in names])
        rows = active.select("node", "up", *[F.col(c).alias(f"r_{c}") for c in names]).join(above, "up")
        moved = rows.select("node", F.col("__up").alias("up"), *[combine[c].alias(c) if c in combine else F.col(f"r_{c}").alias(c) for c in names])
        jumped = state.where("up IS NULL").unionByName(moved)
        if grow is not None:
            given = active.groupBy(F.col("up").alias("node")).agg(F.try_sum(grow).alias("__given"))
            jumped = jumped.join(given, "node", "left").withColumn(grow, F.try_add(grow, F.coalesce("__given", F.lit(0)))).drop("__given")
        state = written(jumped)


def _sizes(links: DataFrame, choice: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node the end of its chain of chosen parents and the places that it and all below it take."""
    chosen = choice.select(F.col("child").alias("node"), F.col("parent").alias("up"))
    # A link that is not chosen takes one place of its parent.
    leaves = links.join(choice.select("child", F.col("parent").alias("__chosen")), "child").where(
        "parent <> __chosen").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("__leaves"))
    state = nodes.join(chosen, "node", "left").join(leaves, "node", "left").select(
        "node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("top"),
        (F.coalesce("__leaves", F.lit(0)) + F.col("weight") + 1).cast("long").alias("size"),
    )
    return _lift(written(state), {"top": F.col("a_top")}, grow="size")


def _places(links: DataFrame, choice: DataFrame, sizes: DataFrame, others: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Place and depth of every node in the walk of the chosen tree, and every link with its offset below its parent.

    ``others`` are links to nodes that have no part in the choice, with the places they take.
    """
    sized = links.join(choice.select("child", F.col("parent").alias("__chosen")), "child").withColumn(
        "tree", F.col("parent") == F.col("__chosen")).drop("__chosen")
    sized = sized.join(sizes.select(F.col("node").alias("child"), "size"), "child").withColumn(
        "size", F.when(F.col("tree"), F.col("size")).otherwise(F.lit(1)))
    columns = ["parent", "child", "ord", "tree", "size", "holds", "layer"]
    sized = sized.withColumn("layer", F.lit(REST)).select(*columns).unionByName(others.select(*columns))
    order = ["ord", "child"]
    before = running(in_slices(sized, ["parent"], order), ["parent"], [F.col(c) for c in order],
                     [Measure("__before", "sum", F.col("size"))], F.col("__slice_part"))
    # A node stands behind a free place, where children of several parents may come.
    offset = F.coalesce("__before", F.lit(0)) + F.when(F.col("tree"), F.lit(2)).otherwise(F.lit(1))
    items = written(before.select("parent", "child", "ord", "tree", "holds", "layer", offset.cast("long").alias("offset")))
    state = items.where((F.col("layer") == REST) & F.col("tree")).select(
        F.col("child").alias("node"), F.col("parent").alias("up"), F.col("offset").alias("place"), F.lit(1).alias("depth"), "holds")
    root = top.select("node", F.lit(None).cast(top.schema["node"].dataType).alias("up"), F.lit(0).cast("long").alias("place"),
                      F.lit(0).alias("depth"), "holds")
    placed = _lift(written(state.unionByName(root)), {c: F.col(f"r_{c}") + F.col(f"a_{c}") for c in ("place", "depth")})
    return placed.where("up IS NULL").drop("up"), items


#: Layer of links that were not peeled, and of links to childless nodes with several parents.
REST, SHARED = -1, -2


def _peeled(core: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers of nodes with one parent and no child left, and the rest, with the places that nodes take.

    A layer is taken only while it holds half of the nodes left: all layers together cost no more than a few
    passes over the nodes, and there are no more of them than doublings of the nodes.
    """
    below = lambda df, *made: df.where("parent IS NOT NULL").groupBy(F.col("parent").alias("child")).agg(*made)
    count = F.count("*").alias("__cores")
    # A node takes its own place and a free one behind its children.
    rest = core.join(below(core, count), "child", "left").select(
        *core.columns, F.lit(2).cast("long").alias("weight"), "__cores",
        (F.col("__cores").isNull() & F.col("__n").isNotNull()).alias("holds"), (F.col("__n") > F.col("__cores")).alias("mixed"))
    layers = []
    while True:
        rest = written(rest)
        free = F.col("alone") & F.col("parent").isNotNull() & F.col("__cores").isNull()
        found = rest.agg(F.count_if(free).alias("free"), F.count("parent").alias("all")).first()
        if found["free"] == 0 or 2 * found["free"] < found["all"]:
            return layers, rest
        layers.append(rest.where(free))
        kept = rest.where(~free).drop("__cores")
        more = below(layers[-1], F.sum(F.col("weight") + 1).alias("__more"))
        rest = kept.join(more, "child", "left").withColumn("weight", F.col("weight") + F.coalesce("__more", F.lit(0))).drop("__more")
        rest = rest.join(below(kept, count), "child", "left")


def _visits(edges: DataFrame, root, directed: bool) -> DataFrame:
    """``(node, depth, place, ord)`` of the walk of ``first_visits``, whose order is that of ``place``, ``ord``, ``node``."""
    links = edges.select("parent", "child", F.col("ord").cast("long").alias("ord"))
    if not directed:
        links = links.unionByName(links.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "ord"))
    kind = links.schema["parent"].dataType
    links = links.where((F.col("parent") != F.col("child")) & (F.col("child") != F.lit(root).cast(kind)))
    if not links.where("ord IS NULL").isEmpty():
        # Repeats need no care but here: a link without order comes first, unless it has one elsewhere.
        links = links.groupBy("parent", "child").agg(F.min("ord").alias("ord"))

    # Nodes with one parent, the root among them, hold their link; links to others are looked up when needed.
    start = edges.sparkSession.range(1).select(F.lit(None).cast(kind).alias("parent"), F.lit(root).cast(kind).alias("child"),
                                               F.lit(None).cast("long").alias("ord"))
    known = links.unionByName(start).groupBy("child").agg(
        F.min("parent").alias("parent"), F.max("parent").alias("__other"), F.min("ord").alias("ord"))
    nodes = written(known.join(links.groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("__n")), "child", "left").select(
        "parent", "child", "ord", F.coalesce(F.col("parent") == F.col("__other"), F.lit(True)).alias("alone"), "__n"))
    shared = nodes.where("NOT alone AND __n IS NULL").select("child")
    several = nodes.where("NOT alone AND __n IS NOT NULL")
    core, single = nodes.where("alone"), several.isEmpty()
    if not single:
        core = written(core.unionByName(links.join(several.select("child", "alone", "__n"), "child").groupBy(
            "parent", "child", "alone", "__n").agg(F.min("ord").alias("ord"))))
    layers, rest = _peeled(core)

    peeled = rest.limit(0).withColumn("layer", F.lit(REST))
    for number, layer in enumerate(layers):
        peeled = peeled.unionByName(layer.withColumn("layer", F.lit(number)))
    peeled = peeled.withColumns({"tree": F.lit(True), "size": F.col("weight") + 1})
    top = rest.where("parent IS NULL").select(F.col("child").alias("node"), "holds")
    links_left = rest.where("parent IS NOT NULL")
    points = rest.groupBy(F.col("child").alias("node")).agg(F.max("weight").alias("weight"))

    def pick(rows, *by):
        return rows.groupBy("child").agg(F.min_by("parent", F.struct(*by, "parent")).alias("parent"))

    def changed(choice, better):
        renamed = better.withColumnRenamed("parent", "__better")
        return written(choice.join(renamed, "child", "left").select("child", F.coalesce("__better", "parent").alias("parent")))

    # Nodes whose chain of parents does not end at the root turn to a parent whose chain does.
    choice = links_left.select("child", "parent") if single else written(pick(links_left, "ord"))
    while True:
        sizes = _sizes(links_left, choice, points)
        reached = sizes.where(F.col("up").isNull() & (F.col("top") == F.lit(root).cast(kind))).select("node", "size")
        ends = reached.select("node")
        inner = links_left.join(ends.withColumnRenamed("node", "parent"), "parent", "left_semi")
        if single:
            break
        better = written(pick(inner.join(ends.withColumnRenamed("node", "child"), "child", "left_anti"), "ord"))
        if better.isEmpty():
            break
        choice = changed(choice, better)
    if not single:
        inner = written(inner)
        choice = written(choice.join(ends.withColumnRenamed("node", "child"), "child", "left_semi"))
        # Only siblings of what may change its parent are needed until nothing does.
        near = written(peeled.join(inner.select("parent").distinct(), "parent", "left_semi"))
    while not single:
        # Links from nodes out of reach were dropped; the sizes of reached nodes do not hold any.
        placed, items = _places(inner, choice, sizes, near, top)
        at = items.where(F.col("layer") == REST).join(several.select("child"), "child", "left_semi").join(
            placed.select(F.col("node").alias("parent"), "place"), "parent")
        first = at.groupBy("child").agg(F.min_by(F.struct("parent", "tree"), F.col("place") + F.col("offset")).alias("__first"))
        better = written(first.where("NOT __first.tree").select("child", F.col("__first.parent").alias("parent")))
        if better.isEmpty():
            break
        choice = changed(choice, better)
        sizes = _sizes(inner, choice, points)

    # Childless nodes with several parents among other children of a parent: their links take no place.
    others = peeled
    mixed = rest.unionByName(layers[0]) if layers else rest
    for layer in layers[1:]:
        mixed = mixed.unionByName(layer)
    mixed = mixed.where("mixed").select(F.col("child").alias("parent")).distinct()
    among = not mixed.isEmpty()
    if among:
        extra = links.join(mixed, "parent", "left_semi").join(shared, "child", "left_semi").withColumns(
            {"tree": F.lit(False), "size": F.lit(0).cast("long"), "holds": F.lit(False), "layer": F.lit(SHARED)})
        others = others.select(*extra.columns).unionByName(extra)
    placed, items = _places(inner, choice, sizes, others, top)
    for number in reversed(range(len(layers))):
        # No table here is small at size, whatever the planner takes it for: none is broadcast.
        above = placed.select(F.col("node").alias("parent"), F.col("place").alias("__place"), F.col("depth").alias("__depth"))
        layer = items.where(F.col("layer") == number).join(above.hint("merge"), "parent").select(
            F.col("child").alias("node"), (F.col("__place") + F.col("offset")).alias("place"), (F.col("__depth") + 1).alias("depth"), "holds")
        placed = placed.unionByName(written(layer))

    # Childless nodes with several parents stand at the first of their links: the rows of the links are joined once.
    above = placed.select(F.col("node").alias("parent"), F.col("place").alias("__place"), F.col("depth").alias("__depth"), "holds")
    places = links.join(above.where("holds").hint("merge"), "parent").withColumn("place", F.col("__place") + 1)
    wanted = ["child", "place", "ord", (F.col("__depth") + 1).alias("depth")]
    places = places.select(*wanted)
    if among:
        places = places.unionByName(items.where(F.col("layer") == SHARED).join(above, "parent").withColumn(
            "place", F.col("__place") + F.col("offset")).select(*wanted))
    first = places.groupBy(F.col("child").alias("node")).agg(F.min(F.struct("place", "ord", "depth")).alias("__first"))
    return placed.select("node", "depth", "place", F.lit(None).cast("long").alias("ord")).unionByName(
        first.select("node", "__first.depth", "__first.place", "__first.ord"))


def first_visits(edges: DataFrame, root, directed: bool = True) -> DataFrame:
    """``(node, place, depth)`` of a depth-first walk from ``root`` that enters every node once.

    ``edges(parent, child, ord)``: a node's children are visited by ``ord``, then ``child``;
    undirected edges are walked both ways.  Rows with a NULL end, loops and repeats of a pair (the
    smallest ``ord`` counts) change nothing; nodes out of reach are left out.  ``place`` numbers
    the nodes by first visit.  ``edges`` is read several times: write it first if it is costly.

    Nodes without children do not change the walk of the others.  With several parents, they wait and take the
    first of their links at the end; with one, they are peeled off in layers that leave their places free,
    as long as a layer holds half of the nodes.  So wide, shallow graphs take a few passes.

    Every node of the rest chooses a parent.  Over the chosen tree, pointer doubling gives the sizes of subtrees
    and, from these, the place of every node and of every link that was not chosen (a
    leaf of its parent).  A node with an earlier link chooses that one, and places are taken again;
    a new parent always stood before its child, so choices never form a circle.  When no node
    has an earlier link, the tree is that of the walk.  Rounds grow with the logarithm of the
    depth, times the changes of choice that follow one another: none in a tree; at most the nodes with
    several parents on one path where there are no circles; with circles up to the nodes themselves.
    """
    walked = _visits(edges, root, directed)
    return global_position(walked, [F.col(c) for c in ("place", "ord", "node")], "__pos").select(
        "node", F.col("__pos").alias("place"), "depth")


def hierarchy_levels(
    edges: DataFrame, root: str, margin: int = 100, root_x: int = 0, root_y: int = 0, directed: bool = True
) -> DataFrame:
    """Depth of every node below ``root`` and its place within the level.

    ``edges(parent, child, ord)``; siblings follow ``ord``, levels follow the order in
    which a depth-first walk meets them.  A node with several parents counts where the
    walk first comes to it (see ``first_visits``).
    """
    walked = _visits(edges, root, directed).withColumnRenamed("depth", "level")
    placed = global_position(walked, [F.col(c) for c in ("level", "place", "ord", "node")], "__pos")
    first = placed.groupBy("level").agg(F.min("__pos").alias("__first"))
    rank = F.col("__pos") - F.col("__first")
    return placed.join(first, "level").select(
        "node", "level", rank.alias("rank"),
        (F.lit(root_x) + rank * margin).alias("x"), (F.lit(root_y) + F.col("level") * margin).alias("y"),
    )
