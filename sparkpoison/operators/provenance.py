"""Lineage graph operators on ``nodes(node_id, …)`` and ``edges(source_id, target_id)``, parent → child.

Walks from given starts are level-by-level joins. Every level is checkpointed, so a lost executor costs
one level, and a node already reached is dropped before the next join. Questions about all nodes
(``blast_radius``, ``check_contamination``, ``find_cycles``) go through ``graphs``, a row per node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkpoison.functions.numeric import round_to
from sparkpoison.operators import graphs
from sparkpoison.operators.graphs import directed as _directed
from sparkpoison.session import checkpoint, discard, stored

DECAY_FACTOR = 0.7
DECAY_STEP = 0.15
CONTAMINATED = 0.3
CONFIRMED = 0.7
MAX_DEPTH = 20

#: fixed values: known origins of a dataset
SOURCE_TYPES = [
    "human_curated", "synthetic_llm", "synthetic_diffusion", "augmented", "scraped", "mixed", "unknown",
]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------------- registration

def register(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new nodes, new edges, rejected) for ``incoming(dataset_id, parent_id, source_type, generation)``.

    Datasets already stored are merged away; a child's generation is its parent's plus one,
    whether the parent is stored or comes in the same batch; an unknown parent, or one that leads back, is rejected.
    """
    # Of several rows of one dataset the smallest by all other columns counts, whichever task sees it first.
    others = [c for c in incoming.columns if c != "dataset_id"]
    single = incoming.groupBy("dataset_id").agg(F.min(F.struct(*others)).alias("_row")).select("dataset_id", "_row.*").select(*incoming.columns)
    fresh = single.join(stored.select("dataset_id"), "dataset_id", "left_anti")
    known = F.when(F.col("source_type").isin(SOURCE_TYPES), F.col("source_type")).otherwise("unknown")
    fresh = checkpoint(fresh.withColumn("source_type", known))
    # Chains of parents inside the batch are followed by doubling to the dataset whose parent is stored or null.
    ids = fresh.select(F.col("dataset_id").alias("parent_id")).hint("merge")
    inside = checkpoint(fresh.join(ids, "parent_id", "left_semi").select(
        F.lit(0).alias("way"), F.col("dataset_id").alias("node"), F.col("parent_id").alias("to"),
        F.lit(1).cast("bigint").alias("steps"), F.col("dataset_id").alias("low")))
    heads = fresh.join(inside.select(F.col("node").alias("dataset_id")).hint("merge"), "dataset_id", "left_anti")
    parents = stored.select(F.col("dataset_id").alias("parent_id"), F.col("generation").cast("bigint").alias("_g"))
    first = F.when(F.col("parent_id").isNull(), F.coalesce("generation", F.lit(0)).cast("bigint")).otherwise(F.col("_g") + 1)
    heads = checkpoint(heads.join(parents, "parent_id", "left").withColumn("generation", first).where(F.col("generation").isNotNull()).select(*fresh.columns))
    count = inside.count()
    ends = graphs.leap(inside, count) if count else inside
    tops = heads.select(F.col("dataset_id").alias("to"), F.col("generation").alias("_g"))
    placed = ends.join(tops, "to").select(F.col("node").alias("dataset_id"), (F.col("_g") + F.col("steps")).alias("generation"))
    below = fresh.drop("generation").join(placed.hint("merge"), "dataset_id").select(*fresh.columns)
    nodes = checkpoint(heads.unionByName(below))
    edges = nodes.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("source_id"), F.col("dataset_id").alias("target_id")
    )
    rejected = fresh.join(nodes.select("dataset_id"), "dataset_id", "left_anti")
    return nodes, edges, rejected


def upsert(nodes: DataFrame, edges: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after ``incoming(dataset_id, parent_id, …)`` is merged into the stored ones.

    A dataset already stored takes the incoming attributes, is clean again (score 0.0, level ``clean``, where the table has
    these columns) and keeps its parents; every incoming parent that is stored or comes in the same batch is added once.
    Unknown parents add no edge. Of several incoming rows of one dataset the smallest by all other columns gives the
    attributes, whichever task sees it first, and each gives its parent. Rows without a dataset id are left out.
    """
    incoming = incoming.where(F.col("dataset_id").isNotNull() & (F.col("dataset_id").cast("string") != ""))
    known = F.when(F.col("source_type").isin(SOURCE_TYPES), F.col("source_type")).otherwise("unknown")
    rows = incoming.withColumn("source_type", known)
    attributes = [c for c in nodes.columns if c in rows.columns and c != "dataset_id"]
    winner = rows.groupBy("dataset_id").agg(F.min(F.struct(*attributes, "parent_id")).alias("_new"))
    kinds = dict(nodes.dtypes)
    reset = {"contamination_score": F.lit(0.0), "contamination_level": F.lit("clean")}
    merged = nodes.withColumn("_old", F.lit(True)).join(winner, "dataset_id", "full")
    columns = []
    for c in nodes.columns:
        new = F.col(f"_new.{c}") if c in attributes else reset.get(c, F.col(c))
        columns.append(F.col(c) if c == "dataset_id" else F.when(F.col("_new").isNotNull(), new).otherwise(F.col(c)).cast(kinds[c]).alias(c))
    merged = merged.select(*columns)
    asked = rows.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("source_id"), F.col("dataset_id").alias("target_id"))
    added = asked.join(merged.select(F.col("dataset_id").alias("source_id")), "source_id", "left_semi")
    return merged, edges.select("source_id", "target_id").unionByName(added.select("source_id", "target_id")).distinct()


# --------------------------------------------------------------------------- walks

def reachable(edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(start_id, node_id, depth): every node reachable from each start with its shortest distance."""
    hops = checkpoint(_directed(edges, direction))
    frontier = checkpoint(
        starts.select(F.col("start_id"), F.col("start_id").alias("node_id"), F.lit(0).alias("depth")).distinct()
    )
    levels, depth = [frontier], 0
    seen = frontier.select("start_id", "node_id")
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            frontier.join(hops.hint("merge"), frontier["node_id"] == hops["here"])
            .select("start_id", F.col("there").alias("node_id")).distinct()
            .join(seen.hint("merge"), ["start_id", "node_id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = checkpoint(step)
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("start_id", "node_id"))
        if depth % 16 == 0:
            seen = checkpoint(seen)
    return _union(levels)


def paths(edges: DataFrame, starts: DataFrame, direction: str = "up", max_depth: int | None = 10, everywhere: bool = False) -> DataFrame:
    """(start_id, node_id, depth, path): every simple path from each start, the start included.

    The result is as large as the number of paths; ``blast_radius`` and ``check_contamination`` count without listing.
    Level by level from the starts; with ``everywhere``, where most nodes are starts, by doubling instead: a path of 2d edges
    is two paths of d edges end to end, so the depth costs a logarithm of joins.
    """
    hops = checkpoint(_directed(edges, direction))
    none = starts.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("depth"), F.array("start_id").alias("path"))
    if everywhere:
        wanted = starts.select(F.col("start_id").alias("here")).distinct()
        rows = [p.join(wanted, "here", "left_semi").select(F.col("here").alias("start_id"), F.col("there").alias("node_id"), F.lit(d).alias("depth"), "path")
                for d, p in _doubled(hops, max_depth).items()]
        return _union([none, *rows])
    level = checkpoint(none)
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(hops, level["node_id"] == hops["here"]).where(~F.array_contains("path", F.col("there")))
        level = checkpoint(
            step.select("start_id", F.col("there").alias("node_id"), F.lit(depth).alias("depth"),
                        F.concat("path", F.array("there")).alias("path"))
        )
        if level.isEmpty():
            break
        levels.append(level)
    return _union(levels)


def _doubled(hops: DataFrame, max_depth: int | None) -> dict[int, DataFrame]:
    """{d: (here, there, path)}: the simple paths of d edges from every node."""
    lengths = {1: checkpoint(hops.where("here <> there").select("here", "there", F.array("here", "there").alias("path")))}
    top = 1
    while (max_depth is None or top < max_depth) and not lengths[top].isEmpty():
        until = 2 * top if max_depth is None else min(2 * top, max_depth)
        for depth in range(top + 1, until + 1):
            first = lengths[(depth + 1) // 2].withColumnRenamed("there", "_mid")
            rest = lengths[depth // 2].select(F.col("here").alias("_mid"), "there", F.slice("path", 2, depth // 2).alias("_tail"))
            joined = first.join(rest, "_mid").where(~F.arrays_overlap("path", "_tail"))
            rows = joined.select("here", "there", F.concat("path", "_tail").alias("path"))
            lengths[depth] = rows if until == max_depth else checkpoint(rows)  # the last ones are not built upon
        top = until
    return lengths


#: edges of a path that are joined last, and stored rows behind one task of that join
_TAIL = 3
_ROWS = 100_000


def _streamed(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int, acyclic: bool, text: str | None, derive) -> DataFrame:
    """(start_id, node_id, depth, path, …): the simple paths of at least one edge up from ``starts`` to ``ends(node_id, …)``.

    A path is a head, walked down from its end, and a tail of its ``_TAIL`` edges next to the start. Only heads and tails are
    stored, which are few as most nodes have few or no children; the paths come out of one last join and are never shuffled.
    Tails are stored as numbers and become text behind the last shuffle; what is built upon is removed as soon as nothing reads it.
    ``derive`` adds columns that follow from the end and the depth, once a head. ``text`` joins the nodes of a path, as one
    string from the outset; ``acyclic`` spares the comparison of nodes.
    """
    written = text is not None and acyclic
    single = lambda c: F.col(c).cast("string") if written else F.array(c)
    sep = [F.lit(text)] if written else []
    wanted = starts.select(F.col("start_id").alias("there")).distinct().withColumn("wanted", F.lit(True))
    hops = stored(_directed(edges, "down").where("here <> there").join(wanted.hint("merge"), "there", "left").select("here", "there", F.coalesce("wanted", F.lit(False)).alias("wanted")))
    # A tail is at, n1, n2, …, each the child of the one before; the last one is the start.
    tails = [hops.select(F.col("here").alias("at"), F.col("there").alias("n1"), "wanted")]
    last = min(_TAIL, max_depth)
    while len(tails) < last:
        end, following = f"n{len(tails)}", f"n{len(tails) + 1}"
        ahead = hops.select(F.col("here").alias(end), F.col("there").alias(following), "wanted")
        longer = tails[-1].drop("wanted").join(ahead.hint("merge"), end)
        if not acyclic:
            longer = longer.where(reduce(Column.__and__, [F.col(c) != F.col(following) for c in tails[-1].columns if c != "wanted"]))
        tails.append(stored(longer.select("at", *[f"n{i + 1}" for i in range(len(tails) + 1)], "wanted")))
    tall = stored(tails[-1].select("at").distinct())
    inner = stored(hops.join(tall.withColumnRenamed("at", "there").hint("merge"), "there", "left_semi").select("here", "there"))
    begin = ends.select("*", F.col("node_id").alias("at"), F.lit(0).alias("_d"), single("node_id").alias("head"))
    heads = [stored(begin.join(tall.hint("merge"), "at", "left_semi").select(begin.columns))]
    for depth in range(1, max_depth - last + 1):
        step = heads[-1].join(inner.withColumnRenamed("here", "at").hint("merge"), "at")
        if not acyclic:
            step = step.where(~F.array_contains("head", F.col("there")))
        level = stored(step.select(*ends.columns, F.col("there").alias("at"), F.lit(depth).alias("_d"), F.concat(single("there"), *sep, "head").alias("head")))
        if level.isEmpty():
            discard(level)
            break
        heads.append(level)
    for table in (tall, inner):
        discard(table)
    parts = []
    for length, held in enumerate(tails, 1):
        above = _union(heads) if length == last else begin
        below = held.where("wanted").drop("wanted")
        tasks = max(1, -(-(below.count() + above.count()) // _ROWS))
        nodes = [single(f"n{i}") for i in range(length, 0, -1)]
        tail = F.concat(*[x for n in nodes for x in (*sep, n)][len(sep):])
        above = derive(above.repartition(tasks, "at").withColumn("depth", F.col("_d") + length)).drop("_d")
        below = below.repartition(tasks, "at").select("at", F.col(f"n{length}").alias("start_id"), tail.alias("tail"))
        joined = above.join(below.hint("merge"), "at")
        if not acyclic:
            joined = joined.where(~F.arrays_overlap("head", "tail"))
        parts.append(joined.withColumn("path", F.concat("tail", *sep, "head")).drop("at", "head", "tail"))
    out = _union(parts)
    return out.withColumn("path", F.array_join("path", text)) if text is not None and not acyclic else out


def lineage(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 10, everywhere: bool = False,
            acyclic: bool = False, text: str | None = None) -> DataFrame:
    """Every upstream path of each start with the attributes of the node it ends in.

    With ``everywhere``, where most nodes are starts, ends and starts of the paths are stored apart and joined last;
    ``acyclic`` then spares the search for loops. ``text`` joins the nodes of a path to one string.
    """
    if not everywhere or max_depth < 1:
        rows = paths(edges, starts, "up", max_depth).join(nodes, "node_id")
        return rows if text is None else rows.withColumn("path", F.array_join("path", text))
    own = nodes.join(starts.select("start_id"), F.col("node_id") == F.col("start_id")).withColumn("depth", F.lit(0))
    own = own.withColumn("path", F.array("node_id") if text is None else F.col("node_id").cast("string"))
    return own.unionByName(_streamed(edges, starts, nodes, max_depth, acyclic, text, lambda heads: heads))


def ancestor_chain(nodes: DataFrame, starts: DataFrame, max_depth: int = 20) -> DataFrame:
    """(start_id, position, node_id) along single parent pointers ``nodes(node_id, parent_id)``, at most max_depth nodes."""
    parents = checkpoint(nodes.where(F.col("parent_id").isNotNull()).select(F.col("node_id").alias("here"), F.col("parent_id").alias("there")))
    level = checkpoint(
        starts.select("start_id", F.lit(0).alias("position"), F.col("start_id").alias("node_id"), F.array("start_id").alias("_seen"))
    )
    levels = [level]
    for position in range(1, max_depth):
        step = level.join(parents, level["node_id"] == parents["here"]).where(~F.array_contains("_seen", F.col("there")))
        level = checkpoint(
            step.select("start_id", F.lit(position).alias("position"), F.col("there").alias("node_id"),
                        F.concat("_seen", F.array("there")).alias("_seen"))
        )
        if level.isEmpty():
            break
        levels.append(level)
    return _union(levels).drop("_seen")


def blast_radius(edges: DataFrame, starts: DataFrame, distinct: bool = False, acyclic: bool = False, sketch: bool = False) -> DataFrame:
    """(start_id, total_affected) downstream: simple paths by default, nodes with ``distinct`` (estimated with ``sketch``).

    Both for all nodes at once, without a row per path or per pair of nodes; only inside loops are paths listed. ``acyclic``
    spares the search for loops.
    """
    if distinct:
        total = graphs.reach_counts(edges, "down", sketch=sketch).select(F.col("node_id").alias("start_id"), F.col("reached").alias("total_affected"))
    else:
        links, inner = graphs.walks(edges, "down", acyclic, None, lambda e, n: paths(_upward(e), n, "up", None, True))
        total = graphs.path_totals(links, inner).select(F.col("node").alias("start_id"), F.col("total").alias("total_affected"))
    return starts.select("start_id").distinct().join(total.hint("merge"), "start_id", "left").na.fill(0, ["total_affected"])


def _upward(hops: DataFrame) -> DataFrame:
    """Edges already turned the way to walk, as ``paths(…, "up")`` wants them."""
    return hops.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"))


def shortest_path(edges: DataFrame, source: object, target: object, max_hops: int = 20) -> DataFrame:
    """(hop, node_id) of the shortest path, the smallest one on ties; empty when there is none."""
    hops = checkpoint(_directed(edges, "down"))
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source_id"]
    frontier = spark.range(1).select(F.lit(source).cast(kind).alias("node_id"), F.array(F.lit(source).cast(kind)).alias("path"))
    seen = frontier.select("node_id")
    for _ in range(max_hops + 1):
        found = frontier.where(F.col("node_id") == F.lit(target))
        if not found.isEmpty():
            return found.select(F.posexplode("path").alias("hop", "node_id"))
        frontier = checkpoint(
            frontier.join(hops, frontier["node_id"] == hops["here"]).select(F.col("there").alias("node_id"), "path")
            .join(seen, "node_id", "left_anti")
            .groupBy("node_id").agg(F.min("path").alias("path"))
            .select("node_id", F.concat("path", F.array("node_id")).alias("path"))
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node_id"))
    return frontier.where(F.lit(False)).select(F.posexplode("path").alias("hop", "node_id"))


def lineage_graph(edges: DataFrame, start: object, max_depth: int = 10, deepest: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within max_depth of a node in both directions; a depth beyond ``deepest`` is an error, not cut."""
    if max_depth > deepest:
        raise ValueError(f"max_depth {max_depth} is beyond {deepest}")
    depth = max_depth
    kind = dict(edges.dtypes)["source_id"]
    starts = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("start_id"))
    up = reachable(edges, starts, "up", depth).select("node_id", (-F.col("depth")).alias("level"))
    down = reachable(edges, starts, "down", depth).select("node_id", F.col("depth").alias("level"))
    both = up.unionByName(down.where(F.col("level") > 0))
    ups = up.select(F.col("node_id").alias("source_id"))
    within = both.select(F.col("node_id").alias("target_id")).distinct()
    below = down.where(F.col("level") > 0).select(F.col("node_id").alias("target_id"))
    links = edges.join(ups.hint("merge"), "source_id", "left_semi").join(within.hint("merge"), "target_id", "left_semi").unionByName(
        edges.join(below.hint("merge"), "target_id", "left_semi")
    )
    return both, links.select("source_id", "target_id").distinct()


# --------------------------------------------------------------------------- contamination

def check_contamination(nodes: DataFrame, edges: DataFrame, starts: DataFrame, acyclic: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per start: contaminated ancestor paths, highest decayed score, verdict, ancestors checked.

    Simple paths count, and are counted for all nodes together; only inside loops are they listed. ``acyclic`` spares
    the search for loops. Ancestors are the rows of ``nodes`` that are met, on the way through others too.
    """
    score = F.col("contamination_score")
    marked, looped = nodes.select(F.col("node_id").alias("node"), score.alias("score")), False
    if acyclic:
        hops = _directed(edges, "up").where("here <> there")
    else:
        links, inner = graphs.walks(edges, "up", False, max_depth, lambda e, n: paths(_upward(e), n, "up", max_depth, True))
        looped = not inner.isEmpty()
        hops = _directed(edges, "up").where("here <> there") if looped else links.select("here", "there")
    counted = marked.withColumn("score", F.lit(None).cast("double")) if looped else marked  # walks are not simple paths
    met = graphs.reached(hops, counted, max_depth, DECAY_FACTOR)
    known = [] if met is None else [met]
    if looped or met is None:
        if acyclic:
            links, inner = graphs.walks(edges, "up", True, max_depth, None)
        levels = graphs.path_levels(links, inner, marked.where(F.col("score") > 0), max_depth).where(F.col("depth") > 0)
        per = levels.groupBy(F.col("node").alias("start_id")).agg(
            F.sum("paths").alias("contamination_paths"), F.max(F.col("best") * F.pow(F.lit(DECAY_FACTOR), F.col("depth"))).alias("_max")
        )
    if met is None:
        above = graphs.reach_counts(edges, "up", max_depth, among=nodes.select("node_id")).select(F.col("node_id").alias("start_id"), F.col("reached").alias("total_ancestors"))
    elif looped:
        above = met.select(F.col("node").alias("start_id"), F.col("reached").alias("total_ancestors"))
    else:
        fallen = F.col("best") * F.pow(F.lit(DECAY_FACTOR), F.col("away"))
        above = met.select(F.col("node").alias("start_id"), F.col("paths").alias("contamination_paths"), fallen.alias("_max"), F.col("reached").alias("total_ancestors"))
    out = starts.select("start_id").distinct()
    if looped or met is None:
        out = out.join(per.hint("merge"), "start_id", "left")
    out = checkpoint(out.join(above.hint("merge"), "start_id", "left").na.fill(0).select(
        "start_id", "contamination_paths", round_to("_max", 6).alias("max_decayed_score"),
        (F.col("_max") > CONTAMINATED).alias("is_contaminated"), "total_ancestors",
    ))
    for table in known:
        discard(table)
    return out


def contamination_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, everywhere: bool = False,
                        acyclic: bool = False, text: str | None = None) -> DataFrame:
    """One row per path to a contaminated ancestor; ``everywhere``, ``acyclic`` and ``text`` as in ``lineage``."""
    dirty = nodes.where(F.col("contamination_score") > 0).select("node_id", "contamination_score")
    decayed = round_to(F.col("contamination_score") * F.pow(F.lit(DECAY_FACTOR), F.col("depth")), 6)
    scored = lambda rows: rows.withColumn("decayed_score", decayed)
    if everywhere and max_depth > 0:
        rows = _streamed(edges, starts, dirty, max_depth, acyclic, text, scored)
    else:
        rows = scored(lineage(dirty, edges, starts, max_depth, text=text).where("depth > 0"))
    return rows.select("start_id", F.col("node_id").alias("ancestor_id"), "contamination_score", "path", "depth", "decayed_score")


def propagate(
    nodes: DataFrame, edges: DataFrame, flagged: DataFrame, law: str = "multiplicative",
    factor: float = DECAY_FACTOR, step: float = DECAY_STEP, max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Nodes with the contamination that ``flagged(node_id, score)`` passes on, only ever raised.

    Scores fall with distance, so the best score of a node comes over a shortest path and one
    row per node is enough: each level keeps the nodes it improved. ``multiplicative``:
    score·factor^distance up to max_depth. ``subtractive``: score - step·distance while positive.
    """
    hops = checkpoint(_directed(edges, "down"))
    level = checkpoint(flagged.groupBy("node_id").agg(F.max("score").alias("score")))
    best, depth = level.select("node_id", "score", F.lit(0).alias("hops")), 0
    while law == "subtractive" or depth < max_depth:
        depth += 1
        passed = F.col("score") * factor if law == "multiplicative" else F.col("score") - step
        # 1e-12 keeps a binary remainder of a zero score from passing for a positive one.
        reached = (
            level.join(hops.hint("merge"), level["node_id"] == hops["here"])
            .groupBy(F.col("there").alias("node_id")).agg(F.max(passed).alias("score")).where(F.col("score") > 1e-12)
        )
        known = best.select("node_id", F.col("score").alias("_known"))
        level = checkpoint(
            reached.join(known.hint("merge"), "node_id", "left")
            .where(F.col("_known").isNull() | (F.col("score") > F.col("_known"))).select("node_id", "score")
        )
        if level.isEmpty():
            break
        merged = best.unionByName(level.withColumn("hops", F.lit(depth)))
        best = checkpoint(merged.groupBy("node_id").agg(F.max("score").alias("score"), F.max_by("hops", "score").alias("hops")))
    raised = F.col("score").isNotNull() & (F.col("score") > F.col("contamination_score"))
    origin = F.col("hops") == 0
    return nodes.join(best.hint("merge"), "node_id", "left").select(
        *[c for c in nodes.columns if c != "contamination_score"],
        F.greatest("contamination_score", F.coalesce("score", F.lit(0.0))).alias("contamination_score"),
        F.when(origin, F.when(F.col("score") >= CONFIRMED, "confirmed").otherwise("suspected"))
        .when(raised, "propagated").otherwise("unchanged").alias("contamination_level"),
        F.col("score").isNotNull().alias("is_affected"),
    )


# --------------------------------------------------------------------------- cycles

def find_cycles(edges: DataFrame) -> DataFrame:
    """(node_id, cycle_id): nodes whose lineage leads back to themselves, grouped by their loop."""
    return graphs.loops(edges)


# --------------------------------------------------------------------------- roll-ups

def graph_stats(nodes: DataFrame, verdict: str = "verdict") -> DataFrame:
    v = F.col(verdict)
    return nodes.groupBy("node_type").agg(
        F.count("*").alias("count"), *[F.count_if(v == k).alias(k) for k in ("poisoned", "suspicious", "clean")]
    )


def affected_models(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(start_id, model_id): models within ``hops`` training links of data derived within ``hops`` steps.

    ``edges`` carry ``edge_type``: ``derived_from``, or ``trained_on`` / ``fine_tuned_from``.
    """
    derived = edges.where(F.col("edge_type") == "derived_from")
    trained = edges.where(F.col("edge_type").isin("trained_on", "fine_tuned_from"))
    data = reachable(derived, starts, "down", hops).select(F.col("start_id").alias("origin"), F.col("node_id").alias("start_id"))
    users = reachable(trained, data.select("start_id").distinct(), "down", hops).where(F.col("depth") > 0)
    models = nodes.where(F.col("node_type") == "model").select("node_id")
    return (
        data.join(users.join(models, "node_id", "left_semi"), "start_id")
        .select(F.col("origin").alias("start_id"), F.col("node_id").alias("model_id")).distinct()
    )


def recent_contamination(contaminated: DataFrame, sources: DataFrame, targets: DataFrame, since: str, limit: int = 50) -> DataFrame:
    """The latest contamination edges with both names. The top rows are taken before the joins."""
    top = (
        contaminated.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
        .orderBy(F.col("detected_at").desc(), "source_id", "target_id", F.col("probability").desc()).limit(limit)
    )
    return top.join(sources, "source_id").join(targets, "target_id").select(
        "source_id", "source_name", "target_id", "target_name", "probability", "detected_at"
    )


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, direction, neighbour_id), one row per link and end; lists per node could be unbounded."""
    up = edges.select(F.col("target_id").alias("node_id"), F.lit("parent").alias("direction"), F.col("source_id").alias("neighbour_id"))
    down = edges.select(F.col("source_id").alias("node_id"), F.lit("child").alias("direction"), F.col("target_id").alias("neighbour_id"))
    return nodes.select("node_id").join(up.unionByName(down), "node_id", "left")


def contamination_status(nodes: DataFrame) -> DataFrame:
    """Per tenant: whether anything is contaminated, mean score, count, deepest generation, earliest time."""
    bad = F.col("is_contaminated")
    return nodes.groupBy("tenant_id").agg(
        F.max(bad).alias("is_contaminated"),
        F.coalesce(F.avg(F.when(bad, F.col("contamination_score"))), F.lit(0.0)).alias("contamination_score"),
        F.count_if(bad).alias("affected_nodes"),
        F.coalesce(F.max(F.when(bad, F.col("generation"))), F.lit(0)).alias("traceback_depth"),
        F.min(F.when(bad, F.col("registered_at"))).alias("detected_at"),
    )


def by_generation(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("generation").agg(
        F.count("*").alias("nodes"), F.count_if("is_contaminated").alias("contaminated"),
        F.avg(F.col("is_contaminated").cast("double")).alias("share"),
    )
