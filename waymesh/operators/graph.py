"""Graph operators on edge tables: repeated joins, one shared checkpoint per round.

Nothing but the one-row answer to "did anything change" reaches the driver. Edges hold
``src, dst, road_id, length_m``; many operators also take a ``unit`` column and then treat every unit
(a segment, a junction case) as a graph of its own.
"""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut


def directed_edges(roads: DataFrame) -> DataFrame:
    """Travel edges: 0 and 1 both ways, 2 from start to end, 3 from end to start."""
    d = F.col("direction")
    ways = F.array(F.when(d.isin(0, 1, 2), F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))),
                   F.when(d.isin(0, 1, 3), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    keep = [c for c in roads.columns if c not in ("src", "dst")]
    return roads.select(*keep, F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select(
        *keep, F.col("w.a").alias("src"), F.col("w.b").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both orientations."""
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    pair = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(*keep, F.explode(pair).alias("w")).select(*keep, F.col("w.a").alias("src"), F.col("w.b").alias("dst"))


def _fingerprint(df: DataFrame, *columns: str):
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


MOST_HUBS, LEAST_HUB = 1000, 256
PAIRS_A_TASK, SHUFFLE_PARTS = 4096, "spark.sql.shuffle.partitions"
MOST_IN_ROW = 64


@contextmanager
def _cut_by_rows(spark: SparkSession, rows: int):
    """Shuffles inside are cut by the rows that they hold, never finer than the session asks for; yields their number.

    A round on a few thousand pairs would else make as many tasks and files as one on millions.
    """
    asked = spark.conf.get(SHUFFLE_PARTS)
    parts = min(int(asked), 1 + rows // PAIRS_A_TASK)
    spark.conf.set(SHUFFLE_PARTS, parts)
    try:
        yield parts
    finally:
        spark.conf.set(SHUFFLE_PARTS, asked)


def _with_lowest(pairs: DataFrame, hub_rows: int) -> DataFrame:
    """``u, v, m``: every pair with the smallest ``v`` of its ``u``.

    A ``u`` of more than ``hub_rows`` pairs gets its minimum by broadcast, so its pairs stay where they are. With
    ``hub_rows`` a thousandth of all pairs or more, there are at most a thousand of them.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(low.where(F.col("n") > hub_rows).select("u", F.col("m").alias("hub_m")))
    marked = pairs.join(hubs, "u", "left")
    rest = marked.where(F.col("hub_m").isNull()).select("u", "v").join(low.select("u", "m"), "u")
    return rest.unionAll(marked.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m")))


def _star_round(pairs: DataFrame, hub_rows: int):
    """One large-star and one small-star step, and the fingerprint of what they make."""
    both = pairs.select("u", "v").unionAll(pairs.select("v", "u"))
    large = _with_lowest(both, hub_rows).where(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v")
    small = _with_lowest(large, hub_rows).select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
    made = cut(small)
    return made, _fingerprint(made, "u", "v")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node`` → ``component`` (its smallest node) by alternating large-star and small-star rounds.

    The number of rounds grows with the logarithm of the component size, not with its diameter. Minima
    are combined map-side, so a hub with very many edges does not gather in one task.
    """
    pairs = cut(edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = _fingerprint(pairs, "u", "v")
    while True:
        with _cut_by_rows(edges.sparkSession, seen[0]) as parts:
            pairs, now = _star_round(pairs.coalesce(parts), max(LEAST_HUB, 2 * seen[0] // MOST_HUBS))
        if now == seen:
            break
        seen = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    labels = stars.unionAll(roots)
    if nodes is None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def unit_components(edges: DataFrame) -> DataFrame:
    """Components inside each unit: ``unit, node`` → ``component`` named by the smallest node that it has.

    Units of at most ``MOST_IN_ROW`` edges are solved in their own row; only larger ones go through rounds.
    """
    keyed = edges.select("unit", "src", "dst", F.struct("unit").alias("_k"))
    crowded = cut(keyed.groupBy("_k").agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_ROW).select("_k"))
    if crowded.isEmpty():
        return _row_components(keyed)
    many = keyed.join(crowded, "_k", "left_semi")
    found = connected_components(many.select(F.struct("unit", F.col("src").alias("node")).alias("src"), F.struct("unit", F.col("dst").alias("node")).alias("dst")))
    return _row_components(keyed.join(crowded, "_k", "left_anti")).unionAll(
        found.select("node.unit", "node.node", F.col("component.node").alias("component")))


def _row_components(edges: DataFrame) -> DataFrame:
    """``unit_components`` of units with few edges: the edges of a unit join its sets of nodes one after the other."""
    def meets(nodes, e):
        return F.exists(nodes, lambda n: n.eqNullSafe(e["src"]) | n.eqNullSafe(e["dst"]))

    def add(parts, e):
        met = F.array_distinct(F.flatten(F.concat(F.filter(parts, lambda p: meets(p, e)), F.array(F.array(e["src"], e["dst"])))))
        return F.concat(F.filter(parts, lambda p: ~meets(p, e)), F.array(met))

    none = F.array().cast(T.ArrayType(T.ArrayType(edges.schema["src"].dataType)))
    parts = edges.groupBy("unit").agg(F.collect_set(F.struct("src", "dst")).alias("_e")).select(
        "unit", F.explode(F.aggregate("_e", none, add)).alias("_p"))
    low = F.when(~F.exists("_p", lambda n: n.isNull()), F.array_min("_p"))  # a null is smaller than all others
    return parts.select("unit", low.alias("component"), F.explode("_p").alias("node")).select("unit", "node", "component")


def follow_chain(steps: DataFrame) -> DataFrame:
    """End of the chain of every place under a next-place table, by pointer doubling.

    ``steps`` holds ``place, next_place, step_m`` with one row per place that has a next one. Returns
    ``place, end_place, dist_m, hops, closed``; ``closed`` marks places whose chain never ends (their other
    columns are null). Only places still on their way take part in a round. Behind a place at some distance
    from its end lie places at every smaller distance, so a round that brings no place to its end is the last:
    rounds grow with the logarithm of the longest chain that ends, whatever loops there are.
    """
    ahead = steps.select(F.col("next_place").alias("end_place"), "place", F.col("step_m").cast("double").alias("dist_m"), F.lit(1).cast("bigint").alias("hops"))
    going_on = ahead.select(F.col("place").alias("end_place"), F.lit(True).alias("_on")).distinct()
    state = cut(ahead.join(going_on, "end_place", "left").select("place", "end_place", "dist_m", "hops", F.coalesce("_on", F.lit(False)).alias("_on")))
    moving, done = state.where("_on"), state.where("NOT _on").drop("_on")
    while True:
        on = done.withColumn("_on", F.lit(False)).unionAll(moving).select(F.col("place").alias("end_place"), F.col("end_place").alias("_end"), F.col("dist_m").alias("_d"), F.col("hops").alias("_h"), "_on")
        moved = cut(moving.drop("_on").join(on, "end_place").select("place", F.col("_end").alias("end_place"), (F.col("dist_m") + F.col("_d")).alias("dist_m"),
                                                                    (F.col("hops") + F.col("_h")).alias("hops"), "_on"))
        arrived = moved.where("NOT _on").drop("_on")
        if arrived.isEmpty():
            break
        done, moving = done.unionAll(arrived), moved.where("_on")
    finished = done.withColumn("closed", F.lit(False))
    loops = moved.select("place", F.lit(None).cast(state.schema["end_place"].dataType).alias("end_place"), F.lit(None).cast("double").alias("dist_m"),
                         F.lit(None).cast("bigint").alias("hops"), F.lit(True).alias("closed"))
    return finished.unionAll(loops)


def flatten_aliases(aliases: DataFrame) -> DataFrame:
    """Root of every alias chain: ``alias_id`` → ``root_id``."""
    real = aliases.where(F.col("alias_id") != F.col("target_id"))
    ends = follow_chain(real.select(F.col("alias_id").alias("place"), F.col("target_id").alias("next_place"), F.lit(0.0).alias("step_m")))
    flat = cut(ends.select(F.col("place").alias("alias_id"), F.col("end_place").alias("root_id"), "hops", "closed"))
    ring = flat.where("closed").select("alias_id")
    if ring.isEmpty():
        return flat
    # aliases that lead into a ring have no end: all of them take the smallest id they are connected with
    rings = connected_components(real.join(ring, "alias_id", "left_semi").select(F.col("alias_id").alias("src"), F.col("target_id").alias("dst")))
    named = rings.select(F.col("node").alias("alias_id"), "component")
    return flat.join(named, "alias_id", "left").select("alias_id", F.coalesce("component", "root_id").alias("root_id"), "hops", "closed")


def shortest_distances(edges: DataFrame, sources: DataFrame, radius: float | None = None) -> DataFrame:
    """Least distance per ``unit`` and node from the unit's sources, and the last road of the path.

    ``edges`` holds ``src, dst, road_id, length_m`` and, when every unit has its own graph, ``unit``.
    Only nodes improved in the last round are expanded; ``radius`` bounds the search. Sources may carry
    a ``dist_m`` of their own.
    """
    keys = ["unit", "src"] if "unit" in edges.columns else ["src"]
    blank = F.lit(None).cast(edges.schema["road_id"].dataType)
    start = F.col("dist_m") if "dist_m" in sources.columns else F.lit(0.0)
    best = cut(sources.select("unit", "node", start.alias("dist_m"), blank.alias("via_road")).distinct())
    frontier = best
    while True:
        step = frontier.withColumnRenamed("node", "src").join(edges, keys)
        offers = step.select("unit", F.col("dst").alias("node"), (F.col("dist_m") + F.col("length_m")).alias("d"), F.col("road_id").alias("r"))
        if radius is not None:
            offers = offers.where(F.col("d") <= radius)
        offers = offers.groupBy("unit", "node").agg(F.min(F.struct("d", "r")).alias("o"))
        merged = best.join(offers, ["unit", "node"], "full_outer")
        better = F.col("o").isNotNull() & (F.col("dist_m").isNull() | (F.col("o.d") < F.col("dist_m")))
        both = cut(merged.select("unit", "node", F.when(better, F.col("o.d")).otherwise(F.col("dist_m")).alias("dist_m"),
                                 F.when(better, F.col("o.r")).otherwise(F.col("via_road")).alias("via_road"), better.alias("_new")))
        best, frontier = both.drop("_new"), both.where("_new").drop("_new")
        if frontier.isEmpty():
            return best


def reachable(edges: DataFrame, starts: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Nodes reached per ``unit``; expansion does not go on from ``stops``.

    ``edges`` may hold ``unit``. Visited pairs are kept apart from the frontier, so each is expanded once.
    """
    keys = ["unit", "src"] if "unit" in edges.columns else ["src"]
    visited = cut(starts.select("unit", "node").distinct())
    frontier = visited
    halted = None if stops is None else stops.select("node").distinct()
    while True:
        found = frontier.withColumnRenamed("node", "src").join(edges, keys).select("unit", F.col("dst").alias("node")).distinct()
        fresh = cut(found.join(visited, ["unit", "node"], "left_anti"))
        if fresh.isEmpty():
            return visited
        visited = cut(visited.unionAll(fresh))
        frontier = fresh if halted is None else fresh.join(halted, "node", "left_anti")


def pairs_reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether ``b`` can be reached from ``a`` inside each unit; ``pairs`` holds ``unit, a, b``."""
    seen = reachable(edges, pairs.select("unit", F.col("a").alias("node")))
    return pairs.join(seen.select("unit", F.col("node").alias("b"), F.lit(True).alias("_r")), ["unit", "b"], "left").select(
        "unit", "a", "b", F.coalesce("_r", F.lit(False)).alias("reached"))


def prune_leaves(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Edges left after unprotected nodes with at most one neighbour are dropped again and again."""
    kept = cut(edges)
    keys = ["unit", "node"] if "unit" in edges.columns else ["node"]
    while True:
        ends = kept.where(F.col("src") != F.col("dst")).select(
            *keys[:-1], F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
                                          F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select(*keys[:-1], "e.*")
        leaves = ends.groupBy(*keys).agg((F.min("other") == F.max("other")).alias("is_leaf")).where("is_leaf").select(*keys)
        if protected is not None:
            leaves = leaves.join(protected.select(*keys), keys, "left_anti")
        leaves = cut(leaves)
        if leaves.isEmpty():
            return kept
        for end in ("src", "dst"):
            kept = kept.join(leaves.withColumnRenamed("node", end), [*keys[:-1], end], "left_anti")
        kept = cut(kept)


def bridge_edges(edges: DataFrame) -> DataFrame:
    """Edges on no cycle.

    A breadth-first forest is grown from the smallest node of each component. Every other edge carries two
    64-bit marks; a tree edge is a bridge when the marks of all edges that leave the subtree below it
    cancel out. Subtree marks are summed with ``bit_xor`` level by level, so no component is gathered.
    """
    real = cut(edges.where("src != dst").select("src", "dst", "road_id"))
    roots = connected_components(real).select(F.col("component").alias("node")).distinct()
    around = both_ways(real)
    level = 0
    none = F.lit(None).cast(real.schema["road_id"].dataType)
    frontier = cut(roots.select("node", none.alias("tree_road"), F.lit(None).cast(real.schema["src"].dataType).alias("parent"), F.lit(0).alias("depth")))
    forest = frontier
    while True:
        offers = frontier.select(F.col("node").alias("src")).join(around, "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(F.struct("road_id", "src")).alias("o"))
        level += 1
        frontier = cut(offers.join(forest, "node", "left_anti").select(
            "node", F.col("o.road_id").alias("tree_road"), F.col("o.src").alias("parent"), F.lit(level).alias("depth")))
        if frontier.isEmpty():
            break
        forest = cut(forest.unionAll(frontier))
    tree = forest.where(F.col("tree_road").isNotNull()).select(F.col("tree_road").alias("road_id"))
    marks = real.join(tree, "road_id", "left_anti").select(
        F.explode(F.array("src", "dst")).alias("node"), F.xxhash64("road_id").alias("a"), F.xxhash64("road_id", F.lit(1)).alias("b"))
    own = marks.groupBy("node").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    below = cut(forest.join(own, "node", "left").select("node", "parent", "tree_road", "depth",
                                                        F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")))
    done = None
    for depth in range(level - 1, 0, -1):
        here = below.where(F.col("depth") == depth)
        done = here if done is None else done.unionAll(here)
        up = here.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("a").alias("_a"), F.bit_xor("b").alias("_b"))
        rest = below.where(F.col("depth") < depth).join(up, "node", "left")
        below = cut(rest.select("node", "parent", "tree_road", "depth", F.col("a").bitwiseXOR(F.coalesce("_a", F.lit(0))).alias("a"),
                                F.col("b").bitwiseXOR(F.coalesce("_b", F.lit(0))).alias("b")))
        done = cut(done)
    if done is None:
        return real.limit(0).select("road_id")
    return done.where((F.col("a") == 0) & (F.col("b") == 0)).select(F.col("tree_road").alias("road_id"))


def node_degrees(edges: DataFrame) -> DataFrame:
    return edges.where("src != dst").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def contract_chains(edges: DataFrame) -> DataFrame:
    """Chain of every road: roads that meet in nodes of degree two belong together.

    Returns ``road_id, chain_id`` with the smallest road of the chain as its id.
    """
    real = edges.where("src != dst")
    ends = real.select("road_id", F.explode(F.array("src", "dst")).alias("node"))
    pairs = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("road_id").alias("src"), F.max("road_id").alias("dst")).where("n = 2")
    labels = connected_components(pairs.select("src", "dst"), real.select(F.col("road_id").alias("node")))
    return labels.select(F.col("node").alias("road_id"), F.col("component").alias("chain_id"))


def conflict_components(members: DataFrame) -> DataFrame:
    """Groups of owners that share members: ``owner`` → ``component``.

    Owners of one member are tied to its smallest owner instead of to each other, so a member shared by
    very many owners yields one edge per owner.
    """
    low = members.groupBy("member").agg(F.min("owner").alias("dst"))
    ties = members.join(low, "member").select(F.col("owner").alias("src"), "dst")
    return connected_components(ties, members.select(F.col("owner").alias("node")).distinct()).select(
        F.col("node").alias("owner"), "component")


def topo_offsets(edges: DataFrame) -> DataFrame:
    """Least offset of every node along a directed graph from its sources; nodes on cycles are flagged.

    Nodes without open predecessors are settled round by round; what can never be settled lies on or
    behind a cycle and keeps the offset it has, or 0.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    indegree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    state = cut(nodes.join(indegree, "node", "left").select(
        "node", F.coalesce("open", F.lit(0)).alias("open"),
        F.when(F.col("open").isNull(), F.lit(0.0)).alias("offset_m"), F.lit(False).alias("settled")))
    while True:
        ready = state.where("open = 0 AND NOT settled")
        if ready.isEmpty():
            break
        offers = ready.select(F.col("node").alias("src"), "offset_m").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(F.col("offset_m") + F.col("length_m")).alias("_o"), F.count("*").alias("_n"))
        state = cut(state.join(offers, "node", "left").select(
            "node", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"),
            F.least("offset_m", "_o").alias("offset_m"), (F.col("settled") | (F.col("open") == 0)).alias("settled")))
    return state.select("node", F.coalesce("offset_m", F.lit(0.0)).alias("offset_m"), (~F.col("settled")).alias("on_cycle"))


def through_pairs(edges: DataFrame, seeds: DataFrame, terminals: DataFrame, through: DataFrame) -> DataFrame:
    """Pairs of a seed and the terminals it reaches through pass-through nodes only, found both ways.

    Seeds that are themselves pass-through still start a search.
    """
    stops = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(through, "node", "left_anti")
    starts = seeds.select(F.col("node").alias("unit"), "node")
    shared = edges.select("src", "dst", "road_id")
    seen = reachable(shared, starts, stops).where("unit != node")
    hits = seen.join(terminals, "node", "left_semi").select(F.col("unit").alias("a"), F.col("node").alias("b"))
    back = hits.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return hits.join(back, ["a", "b"], "left_semi").where("a < b")


def minimum_spanning_links(edges: DataFrame) -> DataFrame:
    """Roads of a minimum spanning forest by Borůvka rounds: every component takes its shortest way out."""
    rest = cut(edges.where("src != dst").select("src", "dst", "road_id", F.col("length_m").cast("double").alias("length_m")))
    chosen = None
    labels = rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        a = labels.select(F.col("node").alias("src"), F.col("component").alias("_a"))
        b = labels.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
        crossing = cut(rest.join(a, "src").join(b, "dst").where("_a != _b"))
        if crossing.isEmpty():
            return crossing.select("road_id") if chosen is None else chosen
        best = crossing.select(F.explode(F.array("_a", "_b")).alias("c"), F.struct("length_m", "road_id").alias("k")).groupBy("c").agg(
            F.min("k").alias("k")).select("k.road_id").distinct()
        chosen = cut(best if chosen is None else chosen.unionAll(best).distinct())
        labels = connected_components(edges.join(chosen, "road_id", "left_semi").select("src", "dst"), labels.select("node"))
        rest = crossing.select("src", "dst", "road_id", "length_m")


def trace_back(distances: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Roads of the shortest paths from the units' sources to their targets.

    ``distances`` comes from ``shortest_distances`` on the same ``edges``. Returns ``unit, target, road_id,
    from_target`` (0 is the last road of the path).
    """
    hop = edges.select(F.col("road_id").alias("via_road"), F.col("dst").alias("node"), F.col("src").alias("_prev"), *(["unit"] if "unit" in edges.columns else []))
    keys = ["via_road", "node"] + (["unit"] if "unit" in edges.columns else [])
    steps = distances.where(F.col("via_road").isNotNull()).join(hop, keys).groupBy("unit", "node", "via_road").agg(F.min("_prev").alias("_prev"))
    steps = cut(steps)
    frontier = targets.select("unit", F.col("node").alias("target"), "node")
    found, level = None, 0
    while True:
        walked = cut(frontier.join(steps, ["unit", "node"]).select("unit", "target", F.col("via_road").alias("road_id"), F.lit(level).alias("from_target"), "_prev"))
        if walked.isEmpty():
            break
        part = walked.drop("_prev")
        found = part if found is None else found.unionAll(part)
        frontier = walked.select("unit", "target", F.col("_prev").alias("node"))
        level += 1
    if found is None:
        return targets.select("unit", F.col("node").alias("target"), F.lit(None).cast(edges.schema["road_id"].dataType).alias("road_id"),
                              F.lit(0).alias("from_target")).limit(0)
    return found


def greedy_select(members: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners kept when taken in order of ``rank`` and each may not share a member with one kept before.

    ``members`` holds ``owner, member``; ``owners`` holds ``owner, rank`` with distinct ranks. An owner that
    ranks first on all of its members is certain, so every round settles all such owners at once.
    """
    open_rows = cut(members.select("owner", "member").distinct().join(owners, "owner"))
    kept = None
    while True:
        best = open_rows.groupBy("member").agg(F.min("rank").alias("_best"))
        sure = cut(open_rows.join(best, "member").groupBy("owner").agg(F.bool_and(F.col("rank") == F.col("_best")).alias("ok")).where("ok").select("owner"))
        if sure.isEmpty():
            return owners.join(kept, "owner", "left_semi") if kept is not None else owners.limit(0)
        kept = sure if kept is None else kept.unionAll(sure)
        taken = open_rows.join(sure, "owner", "left_semi").select("member").distinct()
        hit = open_rows.join(taken, "member", "left_semi").select("owner").distinct()
        open_rows = cut(open_rows.join(hit, "owner", "left_anti"))


def distances_through(edges: DataFrame, starts: DataFrame, stops: DataFrame, radius: float | None = None) -> DataFrame:
    """Least distances from each unit's starts when the search does not go on from stops other than them.

    Stops are still reached. ``starts`` holds ``unit, node``.
    """
    plain = edges.select("src", "dst", "road_id", "length_m")
    onward = plain.join(stops.select(F.col("node").alias("src")), "src", "left_anti")
    first = plain.join(starts.select("unit", F.col("node").alias("src")), "src").groupBy("unit", F.col("dst").alias("node")).agg(
        F.min(F.col("length_m").cast("double")).alias("dist_m"))
    if radius is not None:
        first = first.where(F.col("dist_m") <= radius)
    return shortest_distances(onward, first, radius)
