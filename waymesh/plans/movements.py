"""Movements that a junction of the source network needs, looked for in the fused network; gaps explained by aliases and surfaces; support ownership."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph as GR
from ..operators import search as S
from ..operators import spatial as SP

HEADING_SAMPLE_M = 10.0
MOST_EXTRA_M, MOST_RATIO = 100.0, 1.5


def ends_at(direction: Column, at_start: Column) -> tuple[Column, Column]:
    """Whether travel goes into and out of the junction at one end of a road."""
    both = direction.isin(0, 1)
    return (both | ((direction == 2) & ~at_start) | ((direction == 3) & at_start)), (both | ((direction == 2) & at_start) | ((direction == 3) & ~at_start))


def with_outward_heading(df: DataFrame, at_start: Column, name: str) -> DataFrame:
    """Add the heading from an end of ``pts`` to the place HEADING_SAMPLE_M along it; null for a line without length.

    Step by step, so that every part is computed once per line.
    """
    df = df.withColumn("_line", F.when(at_start, F.col("pts")).otherwise(F.reverse("pts")))
    df = df.withColumn("_pieces", G.measured_pieces(F.col("_line")))
    df = df.withColumn("_total", F.element_at("_pieces", -1)["start"] + F.element_at("_pieces", -1)["len"])
    df = df.withColumn("_away", G.interpolate(F.col("_pieces"), F.least(F.lit(HEADING_SAMPLE_M), F.col("_total"))))
    return df.withColumn(name, F.when(F.col("_total") > 0, G.bearing(F.col("_line")[0], F.col("_away")))).drop("_line", "_pieces", "_total", "_away")


def boundary_arms(roads: DataFrame, members: DataFrame) -> DataFrame:
    """Roads with exactly one end in the junction: ``unit, road_id, inside, outside, goes_in, goes_out, heading, pts``.

    ``roads`` holds ``unit, road_id, src, dst, direction, pts``, ``members`` ``unit, node``.
    """
    held = members.select("unit", "node").distinct().withColumn("_in", F.lit(True))
    rows = roads.join(held.select("unit", F.col("node").alias("src"), F.col("_in").alias("_s")), ["unit", "src"], "left").join(
        held.select("unit", F.col("node").alias("dst"), F.col("_in").alias("_d")), ["unit", "dst"], "left")
    at_start = F.col("_s").isNotNull()
    goes_in, goes_out = ends_at(F.col("direction"), at_start)
    return with_outward_heading(rows.where(at_start != F.col("_d").isNotNull()), at_start, "heading").select(
        "unit", "road_id", F.when(at_start, F.col("src")).otherwise(F.col("dst")).alias("inside"), F.when(at_start, F.col("dst")).otherwise(F.col("src")).alias("outside"),
        goes_in.alias("goes_in"), goes_out.alias("goes_out"), "heading", "pts")


def required_movements(roads: DataFrame, arms: DataFrame) -> DataFrame:
    """``unit, in_road, out_road``: pairs of arms where travel comes in by the one and reaches the far end of the other on the source roads."""
    edges = GR.directed_edges(roads.select("unit", "road_id", "src", "dst", "direction"))
    reach = S.reach_of_sets(edges, arms.where("goes_in").select("unit", F.col("road_id").alias("arm"), F.col("outside").alias("node")))
    out = arms.where("goes_out").select("unit", F.col("road_id").alias("out_road"), F.col("outside").alias("node"))
    return reach.join(out, ["unit", "node"]).where(F.col("arm") != F.col("out_road")).select("unit", F.col("arm").alias("in_road"), "out_road").distinct()


def local_carriers(centres: DataFrame, carriers: DataFrame, radius_m: float) -> DataFrame:
    """``unit`` and the carriers (``road_id, src, dst, direction, pts``) that come within the radius of the unit's centre (``unit, x, y``)."""
    near = SP.points_near_lines(centres.select(F.col("unit").alias("p_id"), "x", "y"), carriers.select(F.col("road_id").alias("line_id"), "pts"), radius_m)
    return near.select(F.col("p_id").alias("unit"), F.col("line_id").alias("road_id")).join(carriers, "road_id")


def arm_carriers(arms: DataFrame, carriers: DataFrame, nodes: DataFrame, targets: DataFrame, gap_m: float, anchor_m: float, heading_deg: float) -> DataFrame:
    """Carriers that stand for an arm: near it, anchored at the junction and of its heading.

    ``unit, arm, road_id, inner, goes_in, goes_out, gap_m, anchor_m``. The carrier's inner node is the end nearer to the junction's ``targets`` (``unit, x, y``), then
    the smaller id. ``nodes`` holds ``node, x, y``; carriers with an end that is not there are left out. Arms meet carriers in grid cells, not pair by pair.
    """
    ends = carriers.select("unit", "road_id", "direction", "pts", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(True).alias("at_start")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("at_start")))).alias("e"))
    ends = ends.select("unit", "road_id", "direction", "pts", "e.*").join(nodes.select("node", "x", "y"), "node")
    spots = targets.select("unit", F.col("x").alias("_tx"), F.col("y").alias("_ty")).distinct()
    far = ends.join(spots, "unit").groupBy("unit", "road_id", "node", "at_start").agg(
        F.min(F.sqrt((F.col("x") - F.col("_tx")) ** 2 + (F.col("y") - F.col("_ty")) ** 2)).alias("anchor_m"))
    inner = far.groupBy("unit", "road_id").agg(F.min(F.struct("anchor_m", "node", "at_start")).alias("k"), F.count_distinct("at_start").alias("_n")).where("_n = 2").select("unit", "road_id", "k.*")
    anchored = inner.where(F.col("anchor_m") <= anchor_m).join(carriers, ["unit", "road_id"])
    goes_in, goes_out = ends_at(F.col("direction"), F.col("at_start"))
    anchored = with_outward_heading(anchored, F.col("at_start"), "_h").select(
        "unit", "road_id", F.col("node").alias("inner"), "anchor_m", goes_in.alias("goes_in"), goes_out.alias("goes_out"), "_h", "pts")
    cell = max(2 * gap_m, SP.MIN_CELL_M)
    left = SP.line_cells(arms.select("unit", F.col("road_id").alias("arm"), "heading", "pts"), cell, gap_m).select("unit", "arm", "heading", F.col("p").alias("_p"), "cx", "cy")
    right = SP.line_cells(anchored, cell).select("unit", "road_id", "_h", F.col("p").alias("_q"), "cx", "cy")
    turned = G.angular_distance(F.col("heading"), F.col("_h"))
    pairs = left.join(right, ["unit", "cx", "cy"]).where(turned <= heading_deg).select("unit", "arm", "road_id", G.piece_gap(F.col("_p"), F.col("_q")).alias("gap_m"))
    close = pairs.where(F.col("gap_m") <= gap_m).groupBy("unit", "arm", "road_id").agg(F.min("gap_m").alias("gap_m"))
    return close.join(anchored.drop("_h", "pts"), ["unit", "road_id"])


def alias_portals(found: DataFrame, nodes: DataFrame, surfaces: DataFrame, endpoint_m: float) -> DataFrame:
    """Pairs of inner nodes of one junction, ``unit, a, b``, that are aliases, near each other and joined by a straight line inside one surface.

    ``found`` comes from ``arm_carriers``, ``nodes`` holds ``node, x, y, canonical``, ``surfaces`` ``ring_id, ring``.
    """
    inner = found.select("unit", F.col("inner").alias("node")).distinct().join(nodes, "node")
    held = SP.points_in_rings(inner.select(F.col("node").alias("p_id"), "x", "y").distinct(), surfaces, SP.MIN_CELL_M * 8).join(surfaces, "ring_id")
    inner = inner.join(held.select(F.col("p_id").alias("node"), "ring_id", "ring"), "node")

    def side(prefix):
        return inner.select("unit", "ring_id", "canonical", F.col("node").alias(prefix), G.point(F.col("x"), F.col("y")).alias(f"_{prefix}"), *(["ring"] if prefix == "a" else []))

    pairs = side("a").join(side("b"), ["unit", "ring_id", "canonical"]).where((F.col("a") != F.col("b")) & (G.distance(F.col("_a"), F.col("_b")) <= endpoint_m))
    line = F.struct(F.col("_a.x").alias("x0"), F.col("_a.y").alias("y0"), F.col("_b.x").alias("x1"), F.col("_b.y").alias("y1"), G.distance(F.col("_a"), F.col("_b")).alias("len"))
    crossed = F.exists(G.pieces(F.col("ring")), lambda q: G.segments_meet(line, q))
    return pairs.where(~crossed).select("unit", "a", "b").distinct()


def audit_movements(movements: DataFrame, found: DataFrame, carriers: DataFrame, portals: DataFrame) -> DataFrame:
    """``unit, in_road, out_road, status, basis, reason`` of every required movement.

    ``insufficient_boundary_mapping``: an arm has no carrier; ``missing``: no carrier has the role, or none leads through; ``equivalent``: by carriers
    alone or by an alias portal. All arms of a junction are searched at once, by sets of starts.
    """
    roles = found.groupBy("unit", "arm").agg(F.bool_or("goes_in").alias("in_role"), F.bool_or("goes_out").alias("out_role"))
    edges = GR.directed_edges(carriers.select("unit", "road_id", "src", "dst", "direction"))
    starts = found.where("goes_in").select("unit", "arm", F.col("inner").alias("node"))
    outs = found.where("goes_out").select("unit", F.col("arm").alias("out_road"), F.col("inner").alias("node"))
    through = S.reach_of_sets(edges, starts).withColumnRenamed("arm", "in_road").join(outs, ["unit", "node"]).select("unit", "in_road", "out_road", F.lit(True).alias("raw")).distinct()
    aliased = starts.select("unit", F.col("arm").alias("in_road"), F.col("node").alias("a")).join(portals, ["unit", "a"]).join(
        outs.withColumnRenamed("node", "b"), ["unit", "b"]).select("unit", "in_road", "out_road", F.lit(True).alias("alias")).distinct()
    rows = movements.join(roles.select("unit", F.col("arm").alias("in_road"), F.col("in_role")), ["unit", "in_road"], "left").join(
        roles.select("unit", F.col("arm").alias("out_road"), F.col("out_role")), ["unit", "out_road"], "left").join(
        through, ["unit", "in_road", "out_road"], "left").join(aliased, ["unit", "in_road", "out_road"], "left")
    unmapped, role = F.col("in_role").isNull() | F.col("out_role").isNull(), F.col("in_role") & F.col("out_role")
    # fixed values: states and reasons of the audit
    status = F.when(unmapped, "insufficient_boundary_mapping").when(~role, "missing").when(F.col("raw") | F.col("alias"), "equivalent").otherwise("missing")
    reason = F.when(unmapped, "boundary_carrier_not_locally_anchored").when(~role, "boundary_direction_role_missing").when(F.col("raw") | F.col("alias"), "").otherwise(
        "internal_directed_carrier_missing")
    basis = F.when(unmapped | ~role, "").when(F.col("raw"), "raw_local_directed_carrier").when(F.col("alias"), "canonical_raw_alias_portal").otherwise("")
    return rows.select("unit", "in_road", "out_road", status.alias("status"), basis.alias("basis"), reason.alias("reason"))


def junction_verdicts(audited: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, required, missing, incomplete, status``; incomplete movements alone leave a junction insufficient, missing ones are confirmed beside them."""
    counts = audited.groupBy("unit").agg(F.count("*").alias("required"), F.count_if(F.col("status") == "missing").alias("missing"),
                                         F.count_if(F.col("status") == "insufficient_boundary_mapping").alias("incomplete"))
    zero = F.lit(0).cast("long")
    rows = units.select("unit").distinct().join(counts, "unit", "left").select("unit", *(F.coalesce(c, zero).alias(c) for c in ("required", "missing", "incomplete")))
    blocked = (F.col("required") == 0) | ((F.col("incomplete") > 0) & (F.col("missing") == 0))
    return rows.withColumn("status", F.when(blocked, "insufficient").when(F.col("missing") > 0, "confirmed_missing").otherwise("equivalent"))


#: What explains a direction that the raw carriers lack, by the level of edges that were needed.
EXPLANATIONS = ("raw_carrier", "alias_carrier", "surface_carrier")


def explain_gaps(carriers: DataFrame, nodes: DataFrame, in_surface: DataFrame, pairs: DataFrame, alias_m: float) -> tuple[DataFrame, DataFrame]:
    """Why a direction exists after all: ``unit, a, b, explained_by, length_m, accepted``, and the ways, ``unit, road_id, from_target``.

    Raw carriers are used first, then steps between near aliases of one junction, then moves inside one trusted surface; the least of these that suffices is
    the explanation, with its shortest way. ``carriers`` holds ``unit, road_id, src, dst, direction, length_m``, ``nodes`` ``unit, node, x, y, canonical``, ``in_surface`` ``unit, node,
    surface_id``, ``pairs`` ``unit, a, b, reference_m``. Nodes in one surface are joined through the surface, never to each other; surfaces have ids of their own below 0.
    """
    raw = GR.directed_edges(carriers).select("unit", "src", "dst", "road_id", F.col("length_m").cast("double").alias("length_m"), F.lit(0).alias("level"))
    spots = nodes.select(F.struct("unit", "node", "canonical").alias("k"), "x", "y")
    near = SP.distance_join(spots.select(F.col("k").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly")), spots.select(F.col("k").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry")), alias_m)
    none = F.lit(None).cast(carriers.schema["road_id"].dataType)
    alias = near.where((F.col("l.unit") == F.col("r.unit")) & (F.col("l.canonical") == F.col("r.canonical")) & (F.col("l.node") != F.col("r.node"))).select(
        "l.unit", F.col("l.node").alias("src"), F.col("r.node").alias("dst"), none.alias("road_id"), F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2).alias("length_m"), F.lit(1).alias("level"))
    hub = (-F.col("surface_id") - 1).cast("long")
    moves = GR.both_ways(in_surface.select("unit", F.col("node").alias("src"), hub.alias("dst"), none.alias("road_id"), F.lit(0.0).alias("length_m"), F.lit(2).alias("level")))
    edges = raw.unionByName(alias).unionByName(moves.select(*raw.columns))
    outcome, ways = S.least_relaxation(edges, pairs, len(EXPLANATIONS))
    name = F.when(F.col("level").isNull(), "none")
    for number, explanation in enumerate(EXPLANATIONS):
        name = name.when(F.col("level") == number, explanation)
    rows = outcome.join(pairs.select("unit", "reference_m"), "unit")
    fits = (F.col("length_m") <= MOST_RATIO * F.col("reference_m")) & (F.col("length_m") - F.col("reference_m") <= MOST_EXTRA_M)
    return rows.select("unit", "a", "b", name.alias("explained_by"), "length_m", F.coalesce(fits, F.lit(False)).alias("accepted")), ways.where("road_id IS NOT NULL")


def nearest_support(targets: DataFrame, roads: DataFrame, first_m: float = 64.0) -> DataFrame:
    """``unit, target, road_id, distance_m``: the nearest support road of every target (``unit, target, x, y``) in its unit, then the smaller id.

    Targets look into grid cells; those without a hit look four times as far in the next round, until every target of a unit with roads has one.
    """
    pending = targets.join(roads.select("unit").distinct(), "unit", "left_semi").select(F.struct("unit", "target").alias("p_id"), "x", "y")
    lines = roads.select(F.struct("unit", "road_id").alias("line_id"), "pts")
    found, limit = None, first_m
    while not pending.isEmpty():
        near = SP.points_near_lines(pending, lines, limit).where(F.col("p_id.unit") == F.col("line_id.unit"))
        best = GR.cut(near.groupBy("p_id").agg(F.min(F.struct("dist", F.col("line_id.road_id").alias("r"))).alias("k")).select("p_id", "k.*"))
        found = best if found is None else found.unionAll(best)
        pending = GR.cut(pending.join(best.select("p_id"), "p_id", "left_anti"))
        limit *= 4
    if found is None:
        return targets.select("unit", "target", F.lit(None).cast(roads.schema["road_id"].dataType).alias("road_id"), F.lit(None).cast("double").alias("distance_m")).limit(0)
    return found.select("p_id.unit", "p_id.target", F.col("r").alias("road_id"), F.col("dist").alias("distance_m"))


def support_ownership(targets: DataFrame, roads: DataFrame, tolerance_m: float, endpoint_m: float) -> tuple[DataFrame, DataFrame]:
    """Where every target of a junction projects on its support roads, and the issues of the junction.

    Rows: ``unit, target, road_id, distance_m, component, mode, endpoint, endpoint_degree, near``; units: ``unit, components, issues`` (comma-joined). ``targets`` holds
    ``unit, target, x, y``, ``roads`` ``unit, road_id, src, dst, pts``. Components are named by their smallest node.
    """
    ends = roads.select("unit", "road_id", F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("unit", "node").agg(F.count_distinct("road_id").alias("endpoint_degree"))
    parts = GR.unit_components(roads.select("unit", "src", "dst", "road_id"))
    road_part = roads.select("unit", "road_id", F.col("src").alias("node")).join(parts, ["unit", "node"]).select("unit", "road_id", "component")
    near = nearest_support(targets, roads)
    rows = targets.join(near, ["unit", "target"], "left").join(roads.select("unit", "road_id", "src", "dst", "pts"), ["unit", "road_id"], "left").join(road_part, ["unit", "road_id"], "left")
    at = G.interpolate(G.measured_pieces(F.col("pts")), G.project(G.point(F.col("x"), F.col("y")), F.col("pts"))["measure"])
    to_start, to_end = G.distance(at, F.col("pts")[0]), G.distance(at, F.element_at("pts", -1))
    rows = rows.withColumns({"_s": to_start, "_e": to_end})
    endpoint = F.when(F.least("_s", "_e") <= endpoint_m, F.when(F.col("_s") <= F.col("_e"), F.col("src")).otherwise(F.col("dst")))
    rows = rows.withColumn("node", endpoint).join(degree, ["unit", "node"], "left")
    mode = F.when(F.col("road_id").isNull(), "missing").when(F.col("node").isNull(), "interior").when(F.col("endpoint_degree") >= 2, "shared_endpoint").otherwise("terminal_endpoint")
    rows = GR.cut(rows.select("unit", "target", "road_id", "distance_m", "component", mode.alias("mode"), F.col("node").alias("endpoint"), "endpoint_degree",
                              F.coalesce(F.col("distance_m") <= tolerance_m, F.lit(False)).alias("near")))
    counts = parts.groupBy("unit").agg(F.count_distinct("component").alias("components"))
    by_unit = rows.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("component").alias("owned"), F.bool_or("near").alias("any_near"), F.count_if(F.col("mode") == "terminal_endpoint").alias("terminal"),
                                       F.count_distinct(F.when(F.col("mode") == "terminal_endpoint", F.col("endpoint"))).alias("terminals"), F.bool_or(F.col("mode") == "missing").alias("missing"))
    by_unit = by_unit.join(counts, "unit", "left").withColumn("components", F.coalesce("components", F.lit(0).cast("long")))
    single = (F.col("components") == 1) & (F.col("n") >= 2)
    # fixed values: issue codes
    issues = F.array(F.when(F.col("missing"), "support_carrier_missing"), F.when(single & ~F.col("any_near"), "target_outside_local_support_ownership"),
                     F.when(single & (F.col("terminal") == F.col("n")) & (F.col("terminals") == 1), "target_projects_to_terminal_support_endpoint"),
                     F.when((F.col("owned") > 1) & (F.col("components") > F.greatest(F.lit(2), F.col("n"))), "targets_project_to_disconnected_support_components"))
    return rows, by_unit.select("unit", "components", F.array_join(F.filter(issues, lambda x: x.isNotNull()), ",").alias("issues"))
