"""Preprocessing of source roads, lanes, restrictions and tracks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators.aggregates import covered_groups, in_out_degree, road_ends
from ..operators.arms import incident_ends
from ..operators.graph import connected_components, directed_edges, follow_chain, unit_components
from ..operators.joins import keep_roads_with_both_ends
from ..operators.ordered import sessionize
from ..operators.spatial import points_near_lines


def kind_enrich(roads: DataFrame, raw_roads: DataFrame, limit: float, spacing: float) -> DataFrame:
    """Distinct kind tokens of the raw roads within ``limit`` of each road's samples, in raw-road order.

    Tokens are reduced to one row per road and token before they are gathered.
    """
    samples = roads.select("id", F.posexplode(G.sample(F.col("pts"), spacing)).alias("i", "p"))
    probe = samples.select(F.struct("id", "i").alias("p_id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    near = points_near_lines(probe, raw_roads, limit).select(F.col("p_id.id").alias("id"), "line_id").distinct()
    tokens = near.join(raw_roads.select("line_id", F.posexplode(S.kind_tokens(F.col("kind"))).alias("k", "token")), "line_id")
    firsts = tokens.groupBy("id", "token").agg(F.min(F.struct("line_id", "k")).alias("o"))
    listed = firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "token"))).alias("t"))
    kind = F.array_join(F.transform("t", lambda s: s["token"]), "|")
    joined = roads.select("id").join(listed.select("id", kind.alias("kind")), "id", "left")
    is_event = F.coalesce(S.kind_has_suffix(F.col("kind"), "17"), F.lit(False))
    return joined.withColumn("output", F.when(is_event, "event").otherwise("road"))


def lane_groups(lanes: DataFrame, roads: DataFrame) -> DataFrame:
    """Lanes per road and lane direction: the arrow list in lane order, its ends and whether 1..n is complete.

    Equal lanes are counted before the shuffle, so a link repeated many times moves few rows; ties in
    sequence order by arrow text.
    """
    valid = lanes.where(F.col("lane_dir").isin(2, 3) & (F.trim(F.coalesce("arrow", F.lit(""))) != ""))
    counted = valid.groupBy("link", "lane_dir", "seq", "arrow").agg(F.count("*").cast("int").alias("n"))
    grouped = counted.groupBy("link", "lane_dir").agg(
        F.array_sort(F.collect_list(F.struct("seq", "arrow", "n"))).alias("rows"), F.sum("n").alias("lanes"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    known = roads.where(F.col("direction").between(0, 3)).select(F.col("id").alias("link"), "direction", "pts")
    joined = grouped.join(known, "link")
    arrows = F.array_join(F.flatten(F.transform("rows", lambda r: F.array_repeat(r["arrow"], r["n"]))), ",")
    listed = F.flatten(F.transform("rows", lambda r: F.array_repeat(r["seq"], r["n"])))
    complete = listed == F.sequence(F.lit(1), F.col("lanes").cast("int"))
    flip = S.lane_reversed(F.col("direction"), F.col("lane_dir"))
    return joined.select("link", "lane_dir", arrows.alias("arrows"), "lanes", "first_seq", "last_seq",
                         complete.alias("sequence_complete"), G.orient(F.col("pts"), flip).alias("pts"))


def restriction_lines(pairs: DataFrame) -> DataFrame:
    """Line of a restriction: in-road and out-road joined at their nearest ends."""
    found = pairs.where(F.col("in_pts").isNotNull() & F.col("out_pts").isNotNull())
    return found.withColumn("pts", G.connect(F.col("in_pts"), F.col("out_pts")))


def roundabout_nodes(edges: DataFrame, bit: int = 8) -> DataFrame:
    """Nodes of each roundabout: the smallest is the main node, and rings of several nodes become kind 64."""
    ring = edges.where(F.col("roadtype").bitwiseAND(bit) != 0)
    comp = connected_components(ring)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    return comp.join(sizes, "component").select("node", F.col("component").alias("mainnodeid"),
                                                F.when(F.col("n") > 1, 64).alias("kind_2"))


def divmerge_chain_edges(roads: DataFrame, kinds: DataFrame, limit_m: float, diverge_merge_limit_m: float) -> DataFrame:
    """Chain edges between diverge and merge junctions.

    One-way roads are followed through nodes of degree two with a single way on, up to the next node of
    degree three or more. The edge counts when both ends are diverge or merge junctions and it is
    shorter than the limit, which is longer from a diverge to a merge. Two-way roads take no part.
    """
    oneway = roads.where(F.col("direction").isin(2, 3))
    edges = directed_edges(oneway).select("road_id", "src", "dst", "length_m")
    degrees = oneway.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    onward = edges.select(F.col("src").alias("node"), F.col("road_id").alias("next_road"), F.col("dst").alias("next_dst"), F.col("length_m").alias("step_m"))
    at_end = edges.select("road_id", "src", F.col("dst").alias("node")).join(degrees, "node").where("degree = 2").join(onward, "node").where(
        "next_dst != src")
    unique = at_end.groupBy("road_id").agg(F.count("*").alias("n"), F.first("next_road").alias("next_road"), F.first("step_m").alias("step_m")).where("n = 1")
    ends = follow_chain(unique.select(F.col("road_id").alias("place"), F.col("next_road").alias("next_place"), "step_m"))
    walked = edges.select("road_id", "src", "length_m").join(
        ends.where("NOT closed").select(F.col("place").alias("road_id"), F.col("end_place").alias("last_road"), "dist_m"), "road_id", "left")
    walked = walked.select("src", F.coalesce("last_road", "road_id").alias("last_road"), (F.col("length_m") + F.coalesce("dist_m", F.lit(0.0))).alias("dist_m"))
    reached = walked.join(edges.select(F.col("road_id").alias("last_road"), "dst"), "last_road")
    stop = degrees.where("degree >= 3").select(F.col("node").alias("dst"))
    special = kinds.where(F.col("kind_2").isin(8, 16))
    joined = (reached.join(stop, "dst", "left_semi")
              .join(special.select(F.col("node").alias("src"), F.col("kind_2").alias("src_kind")), "src")
              .join(special.select(F.col("node").alias("dst"), F.col("kind_2").alias("dst_kind")), "dst"))
    limit = F.when((F.col("src_kind") == 16) & (F.col("dst_kind") == 8), diverge_merge_limit_m).otherwise(limit_m)
    return joined.where(F.col("dist_m") < limit).groupBy("src", "dst").agg(F.min("dist_m").alias("dist_m"))


def repair_junction_types(nodes: DataFrame, roads: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Corrected ``kind_2`` of junctions from their ways in and out.

    A T junction (2048) without two ways in and two out becomes plain when a side is empty and a cross
    otherwise, unless leaving out advance-right and side roads gives two and two. A diverge or merge
    with one way in and one out becomes plain. ``confirmed`` rows (``node, kind_2``) win.
    """
    exempt = (F.col("formway").bitwiseAND(128) != 0) | S.kind_has_suffix(F.col("kind"), "0a")
    ends = road_ends(roads.withColumn("_x", exempt))
    degrees = ends.groupBy(F.col("junction_id").alias("node")).agg(
        F.count_if("goes_in").alias("in_degree"), F.count_if("goes_out").alias("out_degree"),
        F.count_if(F.col("goes_in") & ~F.col("_x")).alias("in_core"), F.count_if(F.col("goes_out") & ~F.col("_x")).alias("out_core"),
        F.bool_or("_x").alias("has_exempt"))
    joined = nodes.join(degrees, "node", "left").fillna(0, ["in_degree", "out_degree", "in_core", "out_core"])
    good_t = (F.col("in_degree") == 2) & (F.col("out_degree") == 2)
    excused = F.coalesce("has_exempt", F.lit(False)) & (F.col("in_core") == 2) & (F.col("out_core") == 2)
    empty_side = (F.col("in_degree") == 0) | (F.col("out_degree") == 0)
    repaired = (F.when((F.col("kind_2") == 2048) & ~good_t & ~excused, F.when(empty_side, 1).otherwise(4))
                .when(F.col("kind_2").isin(8, 16) & (F.col("in_degree") == 1) & (F.col("out_degree") == 1), 1)
                .otherwise(F.col("kind_2")))
    result = joined.withColumn("new_kind_2", repaired)
    if confirmed is not None:
        fixes = confirmed.select("node", F.col("kind_2").alias("_fix"))
        result = result.join(fixes, "node", "left").withColumn("new_kind_2", F.coalesce("_fix", "new_kind_2")).drop("_fix")
    return result.select("node", "kind_2", "in_degree", "out_degree", "new_kind_2")


def cross_errors(nodes: DataFrame, roads: DataFrame, group_deg: float = 35.0, parallel_deg: float = 20.0) -> DataFrame:
    """Cross junctions (4) that are none: plain, diverge, merge or T, with the reason.

    Only junctions with few ways reach the direction test, so the directions gathered per junction are
    at most four.
    """
    legs = incident_ends(roads).withColumnRenamed("junction_id", "node")
    inbound, outbound = F.col("role").isin("inbound", "bidirectional"), F.col("role").isin("outbound", "bidirectional")
    counts = legs.groupBy("node").agg(
        F.count("*").alias("roads"), F.count_if(inbound).alias("in_degree"), F.count_if(outbound).alias("out_degree"),
        F.bool_and(F.col("role") != "bidirectional").alias("all_oneway"), F.bool_and(F.col("role") == "bidirectional").alias("all_twoway"))
    crosses = nodes.where(F.col("kind_2") == 4).join(counts, "node")
    few = crosses.where("roads > 2 AND in_degree = 2 AND out_degree = 2").select("node")
    angles = legs.join(few, "node", "left_semi").where(F.col("angle").isNotNull()).groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("angle", inbound.alias("i"), outbound.alias("o")))).alias("a"))
    n = F.size("a")
    gap = F.transform("a", lambda s, i: F.when(i == 0, s["angle"] + 360 - F.element_at("a", -1)["angle"]).otherwise(
        s["angle"] - F.element_at("a", F.greatest(i, F.lit(1)))["angle"]))
    grouped = angles.select("node", F.greatest(F.lit(1), F.size(F.filter(gap, lambda g: g > group_deg))).alias("groups"),
                            (F.array_max(gap) <= 180 + parallel_deg).alias("spread"))
    joined = crosses.join(grouped, "node", "left")
    state = (F.when(F.col("roads") == 1, "plain:only_one_incident_road")
             .when((F.col("roads") == 2) & F.col("all_twoway"), "plain:only_two_bidirectional_roads")
             .when(F.col("roads") == 2, "plain:only_two_incident_roads")
             .when(F.col("all_oneway") & (F.col("in_degree") == 1) & (F.col("out_degree") >= 2), "diverge:oneway_in_1_out_ge_2")
             .when(F.col("all_oneway") & (F.col("out_degree") == 1) & (F.col("in_degree") >= 2), "merge:oneway_out_1_in_ge_2")
             .when(F.col("groups") == 2, F.when(F.col("spread"), "plain:two_parallel_groups"))
             .when((F.col("groups") == 3) & F.col("spread"), "t:t_junction_pattern"))
    return joined.withColumn("state", state).where(F.col("state").isNotNull()).select(
        "node", F.split("state", ":")[0].alias("suggested"), F.split("state", ":")[1].alias("reason"))


def divmerge_pairs(nodes: DataFrame, roads: DataFrame, distance_m: float = 100.0, horizontal_deg: float = 35.0) -> DataFrame:
    """Diverge (one in, two out) whose left way leads to a merge (two in, one out) nearby: a T in disguise.

    ``roads`` holds ``id, src, dst, direction, kind, pts``; ``nodes`` holds ``node, kind_2, x, y``.
    """
    degree = in_out_degree(roads).withColumnRenamed("junction_id", "node")
    typed = nodes.join(degree, "node")
    diverge = typed.where("kind_2 = 16 AND in_degree = 1 AND out_degree = 2").select("node", "x", "y")
    merge = typed.where("kind_2 = 8 AND in_degree = 2 AND out_degree = 1").select(F.col("node").alias("merge"), F.col("x").alias("mx"), F.col("y").alias("my"))
    first, last = F.col("pts")[0], F.element_at("pts", -1)
    ways = directed_edges(roads.withColumn("_s", F.col("src"))).withColumn("_f", F.col("src") == F.col("_s")).select(
        "id", "src", "dst", "kind",
        F.when(F.col("_f"), last["x"] - first["x"]).otherwise(first["x"] - last["x"]).alias("dx"),
        F.when(F.col("_f"), last["y"] - first["y"]).otherwise(first["y"] - last["y"]).alias("dy"))
    into = ways.select(F.col("id").alias("in_id"), F.col("dst").alias("node"), F.col("dx").alias("ix"), F.col("dy").alias("iy"))
    out = ways.select(F.col("id").alias("out_id"), F.col("src").alias("node"), F.col("dst").alias("to_node"), F.col("dx").alias("ox"),
                      F.col("dy").alias("oy"), F.col("kind").alias("out_kind"))
    turn = F.degrees(F.atan2(F.col("ix") * F.col("oy") - F.col("iy") * F.col("ox"), F.col("ix") * F.col("ox") + F.col("iy") * F.col("oy")))
    fan = diverge.join(into, "node").join(out, "node").where("in_id != out_id").withColumn("turn", turn)
    sides = fan.groupBy("node", "x", "y", "in_id").agg(F.count("*").alias("n"), F.max(F.struct("turn", "out_id", "to_node", "out_kind")).alias("left"),
                                                       F.min(F.struct("turn", "out_id")).alias("right")).where("n = 2")
    near = sides.select("node", "x", "y", "left", "right", F.col("left.to_node").alias("merge")).join(merge, "merge")
    apart = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    checked = near.withColumn("apart_m", apart).where((F.col("apart_m") <= distance_m) & (F.abs("left.turn") <= horizontal_deg))
    suppressed = F.when(F.col("right.turn") >= F.col("left.turn"), "vertical_not_on_right_side_of_horizontal").when(
        S.kind_has_suffix(F.col("left.out_kind"), "17"), "associated_road_kind_suffix_17")
    return checked.select(F.col("node").alias("diverge"), "merge", F.round("apart_m", 3).alias("apart_m"), suppressed.alias("suppressed"))


def aggregate_divmerge(chain_edges: DataFrame) -> DataFrame:
    """Chains of diverges and merges become one complex junction (128) named by the smallest member."""
    comp = connected_components(chain_edges)
    return comp.select("node", F.col("component").alias("mainnodeid"), F.when(F.col("node") == F.col("component"), 128).otherwise(0).alias("kind_2"))


def merge_one_to_many(hits: DataFrame, kinds: DataFrame, roads: DataFrame) -> DataFrame:
    """Junctions that share one surface, are not plain and hang together by roads become one junction.

    ``hits`` holds ``surface_id, node``; roads count when both ends are candidates of the same surface.
    Returns the merged nodes with the smallest as main node.
    """
    candidates = hits.join(kinds.where("kind_2 != 1").select("node"), "node", "left_semi").distinct()
    crowded = candidates.groupBy("surface_id").agg(F.count("*").alias("n")).where("n > 1").select("surface_id")
    groups = candidates.join(crowded, "surface_id", "left_semi")
    a = groups.select(F.col("surface_id").alias("unit"), F.col("node").alias("src"))
    b = groups.select(F.col("surface_id").alias("unit"), F.col("node").alias("dst"))
    inner = roads.select("src", "dst").where("src != dst").join(a, "src").join(b, ["unit", "dst"]).select("unit", "src", "dst")
    comp = unit_components(inner)
    whole = groups.withColumnRenamed("surface_id", "unit").join(comp, ["unit", "node"], "left").groupBy("unit").agg(
        F.count("*").alias("n"), F.count("component").alias("linked"), F.count_distinct("component").alias("parts"), F.min("node").alias("mainnodeid"))
    joined = groups.withColumnRenamed("surface_id", "unit").join(whole, "unit")
    connected = (F.col("linked") == F.col("n")) & (F.col("parts") == 1)
    return joined.select(F.col("unit").alias("surface_id"), "node", F.when(connected, F.col("mainnodeid")).alias("mainnodeid"),
                         F.when(connected, "merged").otherwise("not_all_groups_connected").alias("state"))


def clean_carrier(aliases: DataFrame, covered_nodes: DataFrame, roads: DataFrame, touching_roads: DataFrame) -> DataFrame:
    """Roads kept: both ends in junctions whose members are all covered, and the road meets a surface."""
    kept_groups = covered_groups(aliases, covered_nodes).where("all_covered").select("canonical_id")
    kept_nodes = aliases.join(kept_groups, "canonical_id", "left_semi").select("node_id")
    return keep_roads_with_both_ends(roads, kept_nodes).join(touching_roads.select("id").distinct(), "id", "left_semi")


def trajectory_parts(points: DataFrame, key: str, order: list[str], is_break, compare: list[str], width: float) -> DataFrame:
    """Pieces of each track between gaps; a piece of one point cannot form a line and is only audited."""
    parts = sessionize(points, key, order, is_break, compare, width)
    grouped = parts.groupBy(key, "part_no").agg(
        F.count("*").alias("point_count"), F.min(F.struct(*order))["seq"].alias("start_seq"), F.max(F.struct(*order))["seq"].alias("end_seq"))
    name = F.format_string("%s__seg%04d", F.col(key).cast("string"), F.col("part_no") + 1)
    return grouped.select(name.alias("piece_id"), key, (F.col("part_no") + 1).alias("piece_no"), "point_count", "start_seq", "end_seq",
                          F.when(F.col("point_count") < 2, "cannot_form_linestring").alias("discard_reason"))


def merged_surface_cells(surfaces: DataFrame, cell: float) -> DataFrame:
    """Union of the surfaces of each patch as grid cells; cells are made distinct before they are counted."""
    return surfaces.select("patch_id", F.explode(G.cells_of_ring(F.col("ring"), cell)).alias("c")).select("patch_id", "c.cx", "c.cy").distinct()


def missing_layers(found: DataFrame, patches: DataFrame, required: list[str]) -> DataFrame:
    """Required layers that a patch lacks."""
    expected = patches.select("patch_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("layer"))
    return expected.join(found.select("patch_id", "layer").distinct(), ["patch_id", "layer"], "left_anti")
