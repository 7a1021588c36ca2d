"""Searches for many units at once: sets of starts, layers of relaxations, nearest owners, strong components, longest chains, best paths.

``unit`` names a graph of its own (a junction, a segment). All searches run in rounds of joins on the states that changed in the last
round; states are cut to the shared folder after every round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import shortest_distances, trace_back
from .smallgraphs import least_level

WORD_BITS = 63


def reach_of_sets(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``unit, arm, node``: every node that some start of an arm reaches, the starts included.

    ``edges`` holds ``unit, src, dst``, ``starts`` ``unit, arm, node``. All arms of a unit are searched at once: a node carries one bit per
    arm, WORD_BITS arms to a word, and only bits that are new at a node travel on.
    """
    number = F.row_number().over(Window.partitionBy("unit").orderBy("arm")) - 1
    arms = cut(starts.select("unit", "arm").distinct().withColumn("_n", number).select(
        "unit", "arm", F.floor(F.col("_n") / WORD_BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, _n % {WORD_BITS})").alias("bit")))
    key = ["unit", "word", "node"]
    have = cut(starts.join(arms, ["unit", "arm"]).groupBy(*key).agg(F.bit_or("bit").alias("bits")))
    fresh = have
    while True:
        offers = fresh.withColumnRenamed("node", "src").join(edges.select("unit", "src", "dst"), ["unit", "src"]).groupBy(
            "unit", "word", F.col("dst").alias("node")).agg(F.bit_or("bits").alias("offered"))
        fresh = cut(offers.join(have, key, "left").select(*key, F.col("offered").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0)))).alias("bits")).where("bits <> 0"))
        if fresh.isEmpty():
            break
        have = cut(have.unionAll(fresh).groupBy(*key).agg(F.bit_or("bits").alias("bits")))
    return have.join(arms, ["unit", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("unit", "arm", "node")


def least_relaxation(edges: DataFrame, pairs: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The least level of edges with which ``b`` is reached from ``a``, and the shortest way at that level.

    ``edges`` holds ``unit, src, dst, road_id, length_m, level`` (0 to ``levels`` - 1), ``pairs`` one ``unit, a, b`` per unit. The graph is searched in
    layers: a state is a node with the highest level used so far, so the shortest way of every level is kept beside that of the others. Returns
    ``unit, a, b, level, length_m`` (null where nothing reaches) and the ways, ``unit, road_id, from_target``.
    Units of at most ``MOST_IN_ROW`` edges are solved in their own row; only larger ones, and those with a missing or endless length, go through rounds.
    """
    odd = F.col("length_m").isNull() | F.isnan(F.col("length_m").cast("double")) | F.col("src").isNull() | F.col("dst").isNull() | (F.col("length_m") < 0)
    sizes = edges.groupBy("unit").agg(F.count("*").alias("n"), F.bool_or(odd).alias("odd"))
    crowded = cut(sizes.where((F.col("n") > MOST_IN_ROW) | F.col("odd")).select("unit"))
    if crowded.isEmpty():
        return _row_relaxation(edges, pairs, levels)
    outcome, ways = _relaxation_in_rounds(edges.join(crowded, "unit", "left_semi"), pairs.join(crowded, "unit", "left_semi"), levels)
    few, few_ways = _row_relaxation(edges.join(crowded, "unit", "left_anti"), pairs.join(crowded, "unit", "left_anti"), levels)
    return few.unionAll(outcome), few_ways.unionAll(ways)


def _row_relaxation(edges: DataFrame, pairs: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    lists = edges.groupBy("unit").agg(F.collect_list(F.struct("src", "dst", "road_id", F.col("length_m").cast("double").alias("length_m"), "level")).alias("_e"))
    road = edges.schema["road_id"].dataType.simpleString()
    search = F.udf(lambda e, a, b: least_level(e, a, b, levels), f"level:int,length_m:double,way:array<struct<road_id:{road},from_target:int>>")
    known = F.col("unit").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    found = cut(pairs.select("unit", "a", "b").join(lists, "unit", "left").withColumn("_w", F.when(known, search("_e", "a", "b"))).drop("_e"))
    return (found.select("unit", "a", "b", F.col("_w.level").alias("level"), F.col("_w.length_m").alias("length_m")),
            found.select("unit", F.inline("_w.way")))


def _relaxation_in_rounds(edges: DataFrame, pairs: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    layer = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("layer")
    layered = edges.select("*", layer).select(
        "unit", F.struct(F.col("src").alias("node"), "layer").alias("src"), F.struct(F.col("dst").alias("node"), F.greatest("layer", "level").cast("int").alias("layer")).alias("dst"),
        F.struct("road_id", "layer").alias("road_id"), F.col("length_m").cast("double").alias("length_m"))
    sources = pairs.select("unit", F.struct(F.col("a").alias("node"), F.lit(0).alias("layer")).alias("node"))
    found = shortest_distances(layered, sources)
    ends = found.select("unit", F.col("node.node").alias("b"), F.col("node.layer").alias("level"), "dist_m")
    best = ends.groupBy("unit", "b").agg(F.min(F.struct("level", "dist_m")).alias("best"))
    outcome = cut(pairs.select("unit", "a", "b").join(best, ["unit", "b"], "left").select("unit", "a", "b", F.col("best.level").alias("level"), F.col("best.dist_m").alias("length_m")))
    targets = outcome.where("level IS NOT NULL").select("unit", F.struct(F.col("b").alias("node"), F.col("level").cast("int").alias("layer")).alias("node"))
    ways = trace_back(found, layered, targets).select("unit", F.col("road_id.road_id").alias("road_id"), "from_target")
    return outcome, ways


def nearest_owners(edges: DataFrame, owners: DataFrame, tolerance: float) -> DataFrame:
    """``node, owner, dist_m``: the nearest owner of every node within ``tolerance`` along the edges, equal distances to the smaller owner.

    One propagation serves all owners: a node keeps and passes on its best one alone. ``edges`` holds ``src, dst, length_m`` (both
    orientations for roads), ``owners`` ``node, owner``.
    """
    best = cut(owners.groupBy("node").agg(F.min(F.struct(F.lit(0.0).alias("d"), F.col("owner").alias("o"))).alias("k")))
    fresh = best
    while True:
        offers = fresh.withColumnRenamed("node", "src").join(edges.select("src", "dst", F.col("length_m").cast("double").alias("_len")), "src").select(
            F.col("dst").alias("node"), F.struct((F.col("k.d") + F.col("_len")).alias("d"), F.col("k.o").alias("o")).alias("offer")).where(F.col("offer.d") <= tolerance)
        offers = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("k").isNull() | (F.col("offer") < F.col("k")))
        both = cut(best.join(offers, "node", "full_outer").select("node", F.when(better, F.col("offer")).otherwise(F.col("k")).alias("k"), better.alias("_new")))
        best, fresh = both.drop("_new"), both.where("_new").drop("_new")
        if fresh.isEmpty():
            return best.select("node", F.col("k.o").alias("owner"), F.col("k.d").alias("dist_m"))


def _spread_least(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label``: the least label that reaches each node along ``src, dst``."""
    best = cut(labels)
    fresh = best
    while True:
        offers = fresh.withColumnRenamed("node", "src").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        fresh = cut(offers.join(best, "node").where(F.col("offer") < F.col("label")).select("node", F.col("offer").alias("label")))
        if fresh.isEmpty():
            return best
        best = cut(best.unionAll(fresh).groupBy("node").agg(F.min("label").alias("label")))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component``: nodes that reach each other, named by the smallest of them.

    Nodes that no edge enters or none leaves are alone and are taken off again and again, so what is on no cycle goes first. Then
    forward-backward colouring: every node takes the least node that reaches it as colour; within a colour all that
    reach its namesake are one component. What is left starts anew, without edges between colours. ``edges`` holds ``src, dst``; keys may be structs.
    """
    rest = cut(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    every = cut(nodes.select("node").distinct())
    while True:
        inner = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner = cut(inner.select("src", "dst"))
        if inner.isEmpty() or inner.count() == rest.count():
            break
        rest = inner
    rest = inner
    left = cut(every.join(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi"))
    done = every.join(left, "node", "left_anti").select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        colour = _spread_least(rest, left.select("node", F.col("node").alias("label")))
        inside = cut(rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src").join(
            colour.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst").where(F.col("_a") == F.col("_b")).select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where(F.col("node") == F.col("label"))
        held = fresh = cut(roots)
        while True:
            more = fresh.withColumnRenamed("node", "src").join(back, "src").select(F.col("dst").alias("node"), "label").distinct()
            fresh = cut(more.join(held, "node", "left_anti"))
            if fresh.isEmpty():
                break
            held = cut(held.unionAll(fresh))
        found = held.select("node", F.col("label").alias("component"))
        done = cut(done.unionAll(found))
        left = cut(left.join(held, "node", "left_anti"))
        rest = cut(inside.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return done


MOST_IN_ROW = 64


def longest_chains(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Members of the heaviest chain of every unit, ``unit, piece, chain_no, weight``, from its first component on (0).

    ``pieces`` holds ``unit, piece, weight``, ``edges`` ``unit, src, dst`` between pieces. Pieces that lead to each other are one component, which
    weighs as much as all its pieces; the chain is the heaviest path over the components. Of equal chains the one with the smaller last component counts, then
    the smaller one before it, and so on. A unit of few pieces is solved in its row, larger ones in rounds.
    """
    crowded = cut(pieces.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_ROW).select("unit"))
    if crowded.isEmpty():
        return _row_chains(edges, pieces)
    found = _row_chains(edges.join(crowded, "unit", "left_anti"), pieces.join(crowded, "unit", "left_anti"))
    return found.unionByName(_chains_in_rounds(edges.join(crowded, "unit", "left_semi"), pieces.join(crowded, "unit", "left_semi")))


def _row_chains(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    lists = pieces.groupBy("unit").agg(F.collect_list(F.struct("piece", F.col("weight").cast("double").alias("weight"))).alias("_p"))
    arcs = edges.groupBy("unit").agg(F.collect_list(F.struct("src", "dst")).alias("_a"))
    chain = F.udf(_heaviest_chain, f"array<struct<piece:{pieces.schema['piece'].dataType.simpleString()},chain_no:int,weight:double>>")
    return lists.join(arcs, "unit", "left").select("unit", F.inline(chain("_p", "_a")))


def _heaviest_chain(pieces, arcs):
    """The chain of one unit: components from who reaches whom (bits), totals in the order of their ancestors."""
    pieces = sorted(pieces)
    place = {p.piece: i for i, p in enumerate(pieces)}
    n = len(pieces)
    reach = [1 << i for i in range(n)]
    ways = [(place[a.src], place[a.dst]) for a in arcs or () if a.src in place and a.dst in place]
    for i, j in ways:
        reach[i] |= 1 << j
    for k in range(n):
        for i in range(n):
            if reach[i] >> k & 1:
                reach[i] |= reach[k]
    part = [next(j for j in range(n) if reach[i] >> j & 1 and reach[j] >> i & 1) for i in range(n)]
    weight = dict.fromkeys(part, 0.0)
    for i, p in enumerate(pieces):
        weight[part[i]] += p.weight
    before = {c: {part[i] for i, j in ways if part[j] == c and part[i] != c} for c in weight}
    best = {}
    for c in sorted(weight, key=lambda c: sum(reach[d] >> c & 1 for d in weight)):
        loss, last = min(((-best[b][0], b) for b in before[c]), default=(0.0, None))
        best[c] = (weight[c] - loss, last) if loss < 0 else (weight[c], None)
    chain = [min(best, key=lambda c: (-best[c][0], c))]
    while best[chain[-1]][1] is not None:
        chain.append(best[chain[-1]][1])
    number = {c: k for k, c in enumerate(reversed(chain))}
    return [(p.piece, number[part[i]], p.weight) for i, p in enumerate(pieces) if part[i] in number]


def _chains_in_rounds(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """``longest_chains`` of units of any size, by rounds of joins."""
    key = F.struct("unit", F.col("piece").alias("piece"))
    nodes = pieces.select(key.alias("node"))
    arcs = edges.select(F.struct("unit", F.col("src").alias("piece")).alias("src"), F.struct("unit", F.col("dst").alias("piece")).alias("dst"))
    parts = cut(strong_components(arcs, nodes))
    weights = parts.join(pieces.select(key.alias("node"), F.col("weight").cast("double").alias("weight")), "node").groupBy("component").agg(F.sum("weight").alias("weight"))
    links = cut(arcs.join(parts.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst")
                .where(F.col("_a") != F.col("_b")).select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())
    none = F.lit(None).cast(parts.schema["component"].dataType)
    best = cut(weights.select(F.col("component").alias("node"), F.col("weight").alias("total"), "weight", none.alias("before")))
    fresh = best
    while True:
        offers = fresh.select(F.col("node").alias("src"), "total").join(links, "src").groupBy(F.col("dst").alias("node")).agg(
            F.min(F.struct((-F.col("total")).alias("t"), F.col("src").alias("s"))).alias("o"))
        # a component before this one is a better one if more leads to it, or as much and it is the smaller
        sum_ = F.col("weight") - F.col("o.t")
        better = (sum_ > F.col("total")) | ((sum_ == F.col("total")) & F.col("before").isNotNull() & (F.col("o.s") < F.col("before")))
        both = cut(best.join(offers, "node", "left").select(
            "node", F.when(better, sum_).otherwise(F.col("total")).alias("total"), "weight", F.when(better, F.col("o.s")).otherwise(F.col("before")).alias("before"),
            (F.coalesce(better, F.lit(False)) & (F.coalesce(sum_, F.lit(0.0)) > F.col("total"))).alias("_new")))
        best, fresh = both.drop("_new"), both.where("_new").drop("_new")
        if fresh.isEmpty():
            break
    last = best.groupBy(F.col("node.unit").alias("unit")).agg(F.min(F.struct((-F.col("total")).alias("t"), F.col("node").alias("n"))).alias("k"))
    walk = cut(last.select("unit", F.col("k.n").alias("node"), F.lit(0).alias("back")))
    steps, found = best.where("before IS NOT NULL").select("node", "before"), walk
    while True:
        walk = cut(walk.join(steps, "node").select("unit", F.col("before").alias("node"), (F.col("back") + 1).alias("back")))
        if walk.isEmpty():
            break
        found = cut(found.unionAll(walk))
    length = found.groupBy("unit").agg(F.max("back").alias("_most"))
    members = found.join(length, "unit").select(F.col("node").alias("component"), (F.col("_most") - F.col("back")).alias("chain_no"))
    return parts.join(members, "component").join(pieces.select(key.alias("node"), F.col("weight").cast("double").alias("weight")), "node").select(
        "node.unit", "node.piece", "chain_no", "weight")


PATH = "struct<m:double,roads:array<bigint>,nodes:array<bigint>>"


def shortest_paths(edges: DataFrame, ends: DataFrame, limit_m: float) -> tuple[DataFrame, DataFrame]:
    """``unit, m, roads, nodes`` of the shortest path per unit from ``a`` to ``b``, equal lengths by road ids; and units whose search met the limit.

    ``edges`` holds ``unit, src, dst, road_id, length_m`` with positive lengths, ``ends`` one ``unit, a, b`` per unit. A state carries its path, so paths are
    compared in full; they are no longer than the limit allows.
    """
    first = F.struct(F.lit(0.0).alias("m"), F.array().cast("array<bigint>").alias("roads"), F.array("a").alias("nodes"))
    best = cut(ends.select("unit", F.col("a").alias("node"), first.cast(PATH).alias("k")))
    goal = ends.select("unit", F.col("b").alias("_b"))
    fresh, over = best, None
    while True:
        step = fresh.withColumnRenamed("node", "src").join(goal, "unit").where(F.col("src") != F.col("_b")).join(edges, ["unit", "src"]).where(~F.array_contains("k.nodes", F.col("dst")))
        longer = step.select("unit", F.col("dst").alias("node"), F.struct((F.col("k.m") + F.col("length_m")).alias("m"), F.array_append("k.roads", F.col("road_id")).alias("roads"),
                                                                       F.array_append("k.nodes", F.col("dst")).alias("nodes")).cast(PATH).alias("offer"))
        longer = cut(longer)
        met = longer.where(F.col("offer.m") > limit_m).select("unit").distinct()
        over = met if over is None else over.unionAll(met)
        offers = longer.where(F.col("offer.m") <= limit_m).groupBy("unit", "node").agg(F.min("offer").alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("k").isNull() | (F.col("offer") < F.col("k")))
        both = cut(best.join(offers, ["unit", "node"], "full_outer").select("unit", "node", F.when(better, F.col("offer")).otherwise(F.col("k")).alias("k"), better.alias("_new")))
        best, fresh = both.drop("_new"), both.where("_new").drop("_new")
        if fresh.isEmpty():
            break
    return best.join(ends.select("unit", F.col("b").alias("node")), ["unit", "node"]).select("unit", "k.*"), over.distinct()


def best_paths(edges: DataFrame, ends: DataFrame, k: int, limit_m: float) -> DataFrame:
    """The ``k`` best loopless paths per unit within ``limit_m``: ``unit, rank, m, roads, nodes, cut``, equal lengths by road ids.

    By deviation: of every path found last, each prefix is kept and the shortest other way on from its end is searched, without the
    nodes of the prefix and the roads by which paths with that prefix go on. All deviations of all units are searched together. ``cut`` marks units where
    the limit, which is the operator's bound, ended some search.
    """
    found, over = shortest_paths(edges, ends, limit_m)
    chosen = cut(found.select("unit", F.lit(1).alias("rank"), "m", "roads", "nodes"))
    waiting, cuts = None, cut(over)
    latest = chosen
    for rank in range(2, k + 1):
        spot = F.posexplode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("at", "spur")
        spurs = cut(latest.select("unit", "roads", "nodes", spot).select(
            F.struct("unit", "at").alias("unit"), F.slice("roads", F.lit(1), F.col("at")).alias("kept_roads"), F.slice("nodes", F.lit(1), F.col("at")).alias("kept_nodes"), "spur"))
        if spurs.isEmpty():
            break
        bans = spurs.select("unit", "kept_roads").join(chosen.select(F.col("unit").alias("_u"), F.col("roads").alias("_r")), F.col("unit.unit") == F.col("_u")).where(
            (F.size("_r") > F.size("kept_roads")) & (F.slice("_r", F.lit(1), F.size("kept_roads")) == F.col("kept_roads"))).select(
            "unit", F.element_at("_r", F.size("kept_roads") + 1).alias("road_id")).distinct()
        near = spurs.select("unit", F.col("unit.unit").alias("_u"), "kept_nodes", "spur").join(edges.withColumnRenamed("unit", "_u"), "_u").where(
            ~F.array_contains("kept_nodes", F.col("dst")) & ~F.array_contains("kept_nodes", F.col("src")))
        allowed = near.join(bans.withColumnRenamed("road_id", "_ban"), ["unit"], "left").groupBy(
            "unit", "src", "dst", "road_id", "length_m", "spur").agg(F.max(F.coalesce((F.col("_ban") == F.col("road_id")) & (F.col("src") == F.col("spur")), F.lit(False))).alias("_no"))
        allowed = cut(allowed.where(~F.col("_no")).select("unit", "src", "dst", "road_id", "length_m"))
        asked = spurs.select("unit", F.col("spur").alias("a")).join(ends.select(F.col("unit").alias("_u"), "b"), F.col("unit.unit") == F.col("_u")).select("unit", "a", "b")
        more, met = shortest_paths(allowed, asked, limit_m)
        cuts = cut(cuts.unionAll(met.select("unit.unit")).distinct())
        lengths = edges.select("unit", "road_id", F.col("length_m").cast("double").alias("_len")).dropDuplicates(["unit", "road_id"])
        prefix = spurs.select("unit", F.posexplode_outer("kept_roads").alias("_i", "road_id")).withColumn("_u", F.col("unit.unit")).join(
            lengths.withColumnRenamed("unit", "_u"), ["_u", "road_id"], "left").groupBy("unit").agg(F.coalesce(F.sum("_len"), F.lit(0.0)).alias("_m"))
        made = more.join(spurs, "unit").join(prefix, "unit").select(
            "unit.unit", (F.col("_m") + F.col("m")).alias("m"), F.concat("kept_roads", "roads").alias("roads"), F.concat("kept_nodes", "nodes").alias("nodes"))
        cuts = cut(cuts.unionAll(made.where(F.col("m") > limit_m).select("unit")).distinct())
        made = made.where(F.col("m") <= limit_m)
        waiting = cut((made if waiting is None else waiting.unionByName(made)).distinct().join(chosen.select("unit", "roads"), ["unit", "roads"], "left_anti").select("unit", "m", "roads", "nodes"))
        latest = cut(waiting.groupBy("unit").agg(F.min(F.struct("m", "roads", "nodes")).alias("k")).select("unit", F.lit(rank).alias("rank"), "k.*"))
        if latest.isEmpty():
            break
        chosen = cut(chosen.unionByName(latest))
    return chosen.join(cuts.withColumn("cut", F.lit(True)), "unit", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def paths_within(edges: DataFrame, starts: DataFrame, limit_m: float) -> tuple[DataFrame, DataFrame]:
    """All simple paths from the unit's starts of at most ``limit_m`` (``unit, nodes, roads, length_m``), and the units where the limit ended one.

    The limit is the operator's bound: lengths are positive, so no path has more edges than the limit holds shortest edges.
    """
    frontier = starts.select("unit", F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("roads"), F.lit(0.0).alias("length_m"))
    found, over = None, None
    keys = ["unit", "src"] if "unit" in edges.columns else ["src"]
    while True:
        step = frontier.withColumn("src", F.element_at("nodes", -1)).withColumnRenamed("length_m", "_m").join(edges, keys).where(~F.array_contains("nodes", F.col("dst")))
        step = cut(step.select("unit", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("roads", F.col("road_id")).alias("roads"),
                               (F.col("_m") + F.col("length_m")).alias("length_m")))
        met = step.where(F.col("length_m") > limit_m).select("unit")
        frontier = step.where(F.col("length_m") <= limit_m)
        found = frontier if found is None else found.unionAll(frontier)
        over = met if over is None else over.unionAll(met)
        if frontier.isEmpty():
            return found, over.distinct()
