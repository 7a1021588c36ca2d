"""Building of segments from roads between junctions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import max_sampled_distance, vertex_turns
from ..functions.scalar import digest_id, is_inbound, is_outbound
from ..lineage import cut
from ..operators.angles import straightest
from ..operators.graph import (MOST_IN_ROW, conflict_components, connected_components, distances_through, follow_chain, greedy_select, prune_leaves, reachable,
                               shortest_distances, through_pairs, trace_back, unit_components)
from ..operators.smallgraphs import staged_roads


def segment_summary(roads: DataFrame) -> DataFrame:
    """One row per segment; the roads themselves stay in the membership table.

    ``roads`` holds ``segment_id, grade, rank, direction, formway`` (lower ``rank`` is the higher grade).
    """
    return roads.groupBy("segment_id").agg(
        F.count("*").alias("roads"), F.sum("formway").alias("formway_sum"), F.min("rank").alias("best_rank"),
        F.min_by("grade", "rank").alias("best_grade"), F.count_distinct("direction").alias("directions"),
        (F.min("grade") != F.max("grade")).alias("grade_conflict"))


def advance_right_segments(edges: DataFrame, bit: int = 128) -> DataFrame:
    """Connected advance-right roads form one segment named by a digest over its roads."""
    turning = edges.where(F.col("formway").bitwiseAND(bit) != 0)
    comp = connected_components(turning)
    member = turning.join(comp.select(F.col("node").alias("src"), "component"), "src").select("road_id", "component")
    # an advance-right chain is a handful of short ramps, so its list of roads stays small
    ids = member.groupBy("component").agg(F.collect_list(F.col("road_id").cast("string")).alias("ids"))
    named = ids.select("component", digest_id(F.col("ids"), "advance_right_").alias("segment_id"))
    return member.join(named, "component").select("road_id", "segment_id")


def oneway_trace(roads: DataFrame, incoming: DataFrame, outgoing: DataFrame, stops: DataFrame) -> DataFrame:
    """Where each road leads when the straightest next road is taken until a stop junction.

    The successor of a road is fixed, so traces are resolved by pointer doubling; ``closed`` marks loops.
    """
    way_on = straightest(incoming.join(stops, "junction_id", "left_anti"), outgoing, ["junction_id"]).where("in_id != out_id")
    # a road that may be left at both ends keeps its straighter continuation
    single = way_on.groupBy("in_id").agg(F.min(F.struct("turn_deg", "out_id", "junction_id")).alias("s"))
    steps = single.select(F.col("in_id").alias("place"), F.col("s.out_id").alias("next_place"), F.lit(1.0).alias("step_m"))
    ends = follow_chain(steps)
    return roads.select(F.col("id").alias("road_id")).join(
        ends.select(F.col("place").alias("road_id"), F.col("end_place").alias("end_road"), "hops", "closed"), "road_id", "left").select(
        "road_id", F.when(~F.col("closed"), F.col("end_road")).alias("end_road"), F.coalesce("hops", F.lit(0)).alias("hops"),
        F.coalesce("closed", F.lit(False)).alias("closed")).select(
        "road_id", "end_road", F.when(~F.col("closed"), F.col("hops")).alias("hops"), "closed")


def resolve_conflicts(members: DataFrame, owners: DataFrame) -> DataFrame:
    """Best owner of every group of owners that share members: highest score, then smallest id."""
    groups = conflict_components(members).join(owners, "owner")
    order = F.struct(F.col("score").alias("s"), (-F.col("owner")).alias("n"))
    return groups.groupBy("component").agg(F.max_by("owner", order).alias("winner"), F.count("*").alias("owners"))


def working_layers(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Roads that take part in segment building: open nodes, not closed roads, not advance-right ramps."""
    active = nodes.where(F.col("closed_con").isin(2, 3)).select("node")
    usable = roads.where((F.col("road_kind") != 1) & (F.col("formway") != 128))
    starts = usable.join(active.withColumnRenamed("node", "src"), "src", "left_semi")
    return starts.join(active.withColumnRenamed("node", "dst"), "dst", "left_semi")


def neighbour_families(roads: DataFrame) -> DataFrame:
    """Per junction and neighbouring junction: number of roads, those in segments, ways in and out.

    ``roads`` holds ``src, dst, direction, formway, in_segment``; advance-right roads are left out.
    """
    usable = roads.where((F.col("formway").bitwiseAND(128) == 0) & (F.col("src") != F.col("dst")))
    ends = usable.select("direction", "in_segment", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("family"), F.lit(True).alias("at_start")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("family"), F.lit(False).alias("at_start")))).alias("e")).select("direction", "in_segment", "e.*")
    return ends.groupBy("node", "family").agg(
        F.count("*").alias("roads"), F.count_if("in_segment").alias("segment_roads"),
        F.bool_or(is_inbound(F.col("direction"), F.col("at_start"))).alias("has_in"),
        F.bool_or(is_outbound(F.col("direction"), F.col("at_start"))).alias("has_out"))


def retype_refresh(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Cross junctions of grade 1 with three neighbours, one of them along segments, are re-typed."""
    residual = F.col("segment_roads") == 0
    simple = residual & (F.col("roads") == 1) & (F.col("has_in") != F.col("has_out"))
    counts = families.groupBy("node").agg(F.count("*").alias("families"), F.count_if(~residual).alias("segment_families"),
                                          F.count_if(residual).alias("residual_families"), F.count_if(simple).alias("simple_families"))
    hit = (F.col("families") == 3) & (F.col("segment_families") == 1) & (F.col("residual_families") == 2)
    joined = nodes.where("grade_2 = 1 AND kind_2 = 4").join(counts, "node")
    rule = F.when(hit, F.when(F.col("simple_families") == 2, "single_side_family").otherwise("mixed_side_family"))
    return joined.select("node", "families", "segment_families", "residual_families", "simple_families", rule.alias("rule"),
                         F.when(hit, 2).otherwise(F.col("grade_2")).alias("new_grade_2"),
                         F.when(F.col("simple_families") == 2, F.when(hit, 2048)).otherwise(F.col("kind_2")).alias("_k"), "kind_2").select(
        "node", "families", "segment_families", "residual_families", "simple_families", "rule", "new_grade_2",
        F.coalesce("_k", "kind_2").alias("new_kind_2"))


def retype_strict_t(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Cross junctions of grade 1 that are strictly a T before any segment exists.

    Three neighbours, one of them a plain cross that is passed both ways; of the two one-way sides one is a
    plain cross and one a T of lower grade.
    """
    kinds = nodes.select(F.col("node").alias("family"), F.col("grade_2").alias("fg"), F.col("kind_2").alias("fk"))
    typed = families.join(kinds, "family", "left")
    through = F.col("has_in") & F.col("has_out")
    side = (F.col("roads") == 1) & (F.col("has_in") != F.col("has_out"))
    plain = (F.col("fg") == 1) & (F.col("fk") == 4)
    tee = (F.col("fk") == 2048) & (F.col("fg") >= 2)
    counts = typed.groupBy("node").agg(
        F.count("*").alias("families"), F.sum("segment_roads").alias("segment_roads"), F.count_if(through).alias("through"),
        F.count_if(through & plain).alias("through_plain"), F.count_if(~through & side & plain).alias("plain_sides"),
        F.count_if(~through & side & ~plain & tee).alias("t_sides"))
    hit = ((F.col("families") == 3) & (F.col("segment_roads") == 0) & (F.col("through") == 1) & (F.col("through_plain") == 1)
           & (F.col("plain_sides") == 1) & (F.col("t_sides") == 1))
    return nodes.where("grade_2 = 1 AND kind_2 = 4").join(counts, "node").select(
        "node", hit.alias("retyped"), F.when(hit, 2).otherwise(F.col("grade_2")).alias("new_grade_2"), F.when(hit, 2048).otherwise(F.col("kind_2")).alias("new_kind_2"))


def segment_pairs(edges: DataFrame, seeds: DataFrame, through: DataFrame) -> DataFrame:
    """Candidate segments between seeds joined both ways through pass-through nodes, with both lengths."""
    pairs = cut(through_pairs(edges, seeds, seeds, through))
    starts = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(F.col("node").alias("unit"), "node")
    stops = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(through, "node", "left_anti")
    reached = distances_through(edges, starts, stops)
    there = reached.select(F.col("unit").alias("a"), F.col("node").alias("b"), F.col("dist_m").alias("forward_m"))
    back = reached.select(F.col("unit").alias("b"), F.col("node").alias("a"), F.col("dist_m").alias("backward_m"))
    return pairs.join(there, ["a", "b"]).join(back, ["a", "b"])


def validate_pairs(pairs: DataFrame, min_separation: float = 50.0, max_turn: float = 60.0, spacing: float = 10.0) -> DataFrame:
    """Reject reason of candidate segments: carriageways too far apart, or too sharp a turn inside.

    ``pairs`` holds ``pair_id, pts, opposite, junction_width``.
    """
    apart = max_sampled_distance(F.col("pts"), F.col("opposite"), spacing)
    turn = F.array_max(vertex_turns(F.col("pts")))
    measured = pairs.select("pair_id", "junction_width", apart.alias("separation_m"), turn.alias("turn_deg"))
    reason = (F.when(F.col("separation_m") > F.greatest(F.lit(min_separation), F.col("junction_width")), "dual_separation_exceeded")
              .when(F.col("turn_deg") > max_turn, "internal_turn_exceeded"))
    return measured.select("pair_id", "separation_m", "turn_deg", reason.alias("reject_reason"))


def arbitrate_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Winners among candidate segments that share roads, best rank first."""
    kept = greedy_select(members, pairs)
    return pairs.join(kept.select("owner", F.lit(True).alias("_k")), "owner", "left").select(
        "owner", "rank", F.coalesce("_k", F.lit(False)).alias("accepted"))


def segment_body(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Corridor roads of each unit: dead ends pruned, then the part that holds both ends of the unit."""
    kept = prune_leaves(edges, ends)
    comp = unit_components(kept)
    both = ends.join(comp, ["unit", "node"]).groupBy("unit", "component").agg(F.count("*").alias("n")).where("n >= 2")
    inside = comp.join(both, ["unit", "component"], "left_semi").select("unit", F.col("node").alias("src"))
    return kept.join(inside, ["unit", "src"], "left_semi")


def staged_rounds(edges: DataFrame, stages: list[tuple[str, DataFrame, ...]]) -> DataFrame:
    """Assign roads to segments stage by stage; each stage sees only what earlier ones left.

    A stage is ``(name, seeds, through)``. Roads on the shortest way between the ends of a found pair are
    assigned to it; a road wanted by several pairs goes to the smallest. The ends of segments of earlier stages
    are seeds of the later ones too, and no way passes through them. An adaptive stage is ``(name, seeds, through, protected)``:
    its ends that keep just two roads, to two other nodes, are passed and end nothing; those in ``protected`` never are.
    Components of at most ``MOST_IN_ROW`` edges are solved in their own row; only larger ones, and those with a missing or negative length, go through rounds.
    """
    length = F.col("length_m").cast("double")
    odd = length.isNull() | F.isnan(length) | (length < 0) | F.col("src").isNull() | F.col("dst").isNull() | F.col("road_id").isNull()
    # a road in several places ties them: where it is assigned, it is taken from all
    first = edges.groupBy("road_id").agg(F.min("src").alias("dst"))
    links = edges.select("src", "dst").unionAll(edges.select("road_id", "src").join(first, "road_id").select("src", "dst"))
    comp = cut(connected_components(links))
    held = edges.join(comp.withColumnRenamed("node", "src"), "src", "left")
    sizes = held.groupBy("component").agg(F.count("*").alias("n"), F.bool_or(odd).alias("odd"))
    few = cut(sizes.where((F.col("n") <= MOST_IN_ROW) & ~F.col("odd") & F.col("component").isNotNull()).select("component"))
    assigned = _staged_in_rows(held.join(few, "component", "left_semi"), comp.join(few, "component", "left_semi"), stages)
    many = cut(held.join(few, "component", "left_anti").select(*edges.columns))
    if many.isEmpty():
        return assigned
    here = many.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return assigned.unionAll(_staged_in_rounds(many, [(name, seeds.join(here, "node", "left_semi"), *rest) for name, seeds, *rest in stages]))


def _staged_in_rows(edges: DataFrame, comp: DataFrame, stages: list[tuple[str, DataFrame, ...]]) -> DataFrame:
    """``staged_rounds`` of components with few edges."""
    marks, flags = None, ("seed", "through", "protected")
    for number, (_, *sets) in enumerate(stages):
        for flag, nodes in zip(flags, sets):
            part = nodes.select("node", F.lit(number).alias("stage"), *[F.lit(flag == f).alias(f) for f in flags])
            marks = part if marks is None else marks.unionAll(part)
    roads = edges.groupBy("component").agg(F.collect_list(F.struct("src", "dst", "road_id", "length_m")).alias("_e"))
    nodes = comp.join(marks, "node").groupBy("component").agg(F.collect_set(F.struct("node", "stage", *flags)).alias("_m"))
    road, node = (edges.schema[c].dataType.simpleString() for c in ("road_id", "src"))
    adaptive = [len(stage) > 3 for stage in stages]
    solve = F.udf(lambda e, m: staged_roads(e, m, adaptive), f"array<struct<road_id:{road},a:{node},b:{node},stage:int>>")
    names = F.array(*[F.lit(stage[0]) for stage in stages])
    return cut(roads.join(nodes, "component").select(F.inline(solve("_e", "_m"))).select(
        "road_id", F.concat_ws("-", "a", "b").alias("segment_id"), F.get(names, F.col("stage")).alias("stage")))


def _demotable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``nodes`` with two roads that lead to two others: nothing branches off there."""
    met = edges.select("road_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
                                                    F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("m")).select("road_id", "m.*")
    plain = met.groupBy("node").agg(F.count_distinct("road_id").alias("roads"), F.count_distinct("other").alias("others")).where("roads = 2 AND others = 2")
    return nodes.join(plain, "node", "left_semi")


def _staged_in_rounds(edges: DataFrame, stages: list[tuple[str, DataFrame, ...]]) -> DataFrame:
    left, assigned, pool = edges, None, edges.select(F.col("src").alias("node")).limit(0)
    for name, seeds, through, *protected in stages:
        seeds, through = seeds.select("node").unionAll(pool).distinct(), through.join(pool, "node", "left_anti")
        if protected:
            demoted = cut(_demotable(left, seeds.join(protected[0], "node", "left_anti")))
            through = through.join(seeds.unionAll(protected[0].select("node")), "node", "left_anti").select("node").unionAll(demoted)
            seeds = seeds.join(demoted, "node", "left_anti")
        pairs = cut(through_pairs(left, seeds, seeds, through))
        stops = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(through, "node", "left_anti")
        starts = pairs.select(F.struct("a", "b").alias("unit"), F.col("a").alias("node"))
        own = left.join(pairs.select(F.col("a").alias("src"), F.struct("a", "b").alias("unit")), "src").select("unit", "src", "dst", "road_id", "length_m")
        through_edges = left.join(stops.withColumnRenamed("node", "src"), "src", "left_anti")
        unit_edges = own.unionByName(_unit_edges(through_edges, own))
        best = shortest_distances(unit_edges, starts)
        roads = trace_back(best, unit_edges, pairs.select(F.struct("a", "b").alias("unit"), F.col("b").alias("node")))
        owned = roads.groupBy("road_id").agg(F.min("unit").alias("u")).select(
            "road_id", "u", F.concat_ws("-", "u.a", "u.b").alias("segment_id"), F.lit(name).alias("stage"))
        owned = cut(owned)
        pool = pool.unionAll(owned.select(F.explode(F.array("u.a", "u.b")).alias("node"))).distinct()
        owned = owned.drop("u")
        assigned = owned if assigned is None else assigned.unionAll(owned)
        left = cut(left.join(owned.select("road_id"), "road_id", "left_anti"))
    return assigned


def _unit_edges(through_edges: DataFrame, own: DataFrame) -> DataFrame:
    """Pass-through edges that the search of each unit can meet."""
    reach = reachable(through_edges.select("src", "dst", "road_id"), own.select("unit", F.col("dst").alias("node")))
    return through_edges.join(reach.withColumnRenamed("node", "src"), "src").select("unit", "src", "dst", "road_id", "length_m")


def oneway_completion(traces: DataFrame, roads: DataFrame) -> DataFrame:
    """State of one-way roads that no segment took: trace to a stop, loop, or a single road at a dead end."""
    state = (F.when(F.col("closed"), "loop").when(F.col("hops") == 0, "single_road_fallback").otherwise("completed"))
    group = F.when(F.col("closed"), F.col("road_id")).otherwise(F.coalesce("end_road", "road_id"))
    return roads.where(F.col("direction").isin(2, 3)).select("road_id").join(traces, "road_id").select(
        "road_id", group.alias("segment_id"), state.alias("state"))


def shape_cuts(segments: DataFrame, max_turn: float = 60.0) -> DataFrame:
    """Number of the shape piece of every line piece: a new one starts behind each turn above the limit."""
    turns = F.concat(F.array(F.lit(0.0)), vertex_turns(F.col("pts")))
    flags = F.transform(turns, lambda t: F.when(t > max_turn, 1).otherwise(0))
    running = F.aggregate(flags, F.array().cast("array<int>"), lambda acc, f: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + f))
    return segments.select("id", F.posexplode(running).alias("pos", "shape_no"))
