"""Searches for many junctions and segments at once, on blocks of eight nodes with small local geometry; assembly of evidence along axes."""
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import graph as GR
from ..operators import search as S
from ..plans import assembly as A
from ..plans import movements as M
from .graphs import chain_edges
from .registry import query
from .views import VIEW_SQL, point

GAP_M, ANCHOR_M, HEADING_DEG, LOCAL_M, ENDPOINT_M = 10.0, 15.0, 25.0, 200.0, 130.0

# -- the network: blocks of eight nodes in a row of cells, chords, and a second network beside it with other directions ------------------------------

_NX = "CAST(400 * ((({0} - 1) // 8) % 1000) + 40 * (({0} - 1) % 8) AS DOUBLE)"
_NY = "CAST(400 * ((({0} - 1) // 8) // 1000) + (({0} - 1) % 8) * (({0} - 1) % 8) * 13 % 60 AS DOUBLE)"


def node_x(n):
    return (400 * (F.floor((n - 1) / 8) % 1000) + 40 * ((n - 1) % 8)).cast("double")


def node_y(n):
    return (400 * F.floor((n - 1) / 8 / 1000) + ((n - 1) % 8) * ((n - 1) % 8) * 13 % 60).cast("double")


VIEW_SQL["block_edges"] = f"""SELECT road_id, unit, src, dst, length_m, direction, {_NX.format('src')} AS x0, {_NY.format('src')} AS y0, {_NX.format('dst')} AS x1, {_NY.format('dst')} AS y1 FROM (
    SELECT road_id, unit, src, dst, length_m, direction FROM chain_edges UNION ALL
    SELECT 30000000000 + id, (id - 1) // 8, id, id + 4, 9 + id % 5, CAST(id // 8 % 4 AS INTEGER) FROM net_nodes WHERE id % 8 IN (2, 3) AND id + 4 <= (SELECT count(*) FROM customer))"""
VIEW_SQL["block_directed"] = "SELECT road_id, unit, src, dst, length_m FROM block_edges WHERE direction <> 3 UNION ALL SELECT road_id, unit, dst, src, length_m FROM block_edges WHERE direction <> 2"
VIEW_SQL["block_both"] = "SELECT road_id, unit, src, dst, length_m FROM block_edges UNION ALL SELECT road_id, unit, dst, src, length_m FROM block_edges"
VIEW_SQL["block_carriers"] = """SELECT road_id, unit, src, dst, length_m, CAST(CASE WHEN road_id % 3 = 0 THEN (direction + 1) % 4 ELSE direction END AS INTEGER) AS direction, x0, y0 + 2 AS y0, x1, y1 + 2 AS y1
    FROM block_edges WHERE road_id % 7 <> 0"""
VIEW_SQL["carrier_directed"] = "SELECT road_id, unit, src, dst, length_m FROM block_carriers WHERE direction <> 3 UNION ALL SELECT road_id, unit, dst, src, length_m FROM block_carriers WHERE direction <> 2"


def _with_line(edges, shift=0):
    pts = F.array(point(node_x(F.col("src")), node_y(F.col("src")) + shift), point(node_x(F.col("dst")), node_y(F.col("dst")) + shift))
    return edges.withColumn("pts", pts)


def block_edges(v):
    columns = ["road_id", "unit", "src", "dst", "length_m", "direction"]
    chords = v.net_nodes.where((F.col("id") % 8).isin(2, 3) & (F.col("id") + 4 <= v.n_customer)).select(
        (F.col("id") + 30_000_000_000).alias("road_id"), F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("src"), (F.col("id") + 4).alias("dst"),
        (9 + F.col("id") % 5).alias("length_m"), (F.floor(F.col("id") / 8) % 4).cast("int").alias("direction"))
    return _with_line(chain_edges(v).select(*columns).unionByName(chords))


def block_carriers(v):
    turned = F.when(F.col("road_id") % 3 == 0, (F.col("direction") + 1) % 4).otherwise(F.col("direction")).cast("int")
    return _with_line(block_edges(v).where(F.col("road_id") % 7 != 0).withColumn("direction", turned), 2)


def members(v):
    return v.net_nodes.where((F.col("id") % 8).isin(3, 6)).select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("node"))


def carrier_nodes(v):
    id_ = F.col("id")
    return v.net_nodes.select(id_.alias("node"), node_x(id_).alias("x"), (node_y(id_) + 2).alias("y"), F.when(id_ % 8 == 6, id_ - 3).otherwise(id_).alias("canonical"))


def zones(v):
    """Trusted surfaces around every second block."""
    unit = F.floor((F.col("id") - 1) / 8)
    x, y = (400 * (unit % 1000)).cast("double"), (400 * F.floor(unit / 1000)).cast("double")
    ring = F.array(point(x - 20, y - 20), point(x + 300, y - 20), point(x + 300, y + 90), point(x - 20, y + 90), point(x - 20, y - 20))
    return v.net_nodes.where(F.col("id") % 16 == 1).select(F.col("id").alias("ring_id"), ring.alias("ring"))


# -- required movements ---------------------------------------------------------------------------------------------------------------------------

def _to_piece(px, py, a, b):
    """SQL: distance of a point to the straight piece from a to b (prefixes of columns)."""
    x0, y0, x1, y1 = f"{a}x", f"{a}y", f"{b}x", f"{b}y"
    t = (f"greatest(0.0, least(1.0, CASE WHEN {x1} <> {x0} OR {y1} <> {y0} THEN (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) "
         f"/ (pow({x1} - {x0}, 2) + pow({y1} - {y0}, 2)) ELSE 0 END))")
    return f"sqrt(pow({px} - {x0} - {t} * ({x1} - {x0}), 2) + pow({py} - {y0} - {t} * ({y1} - {y0}), 2))"


def _side(p, q, r):
    return f"sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


_MEET = (f"{_side('a0', 'a1', 'b0')} * {_side('a0', 'a1', 'b1')} <= 0 AND {_side('b0', 'b1', 'a0')} * {_side('b0', 'b1', 'a1')} <= 0 "
         "AND greatest(a0x, a1x) >= least(b0x, b1x) AND least(a0x, a1x) <= greatest(b0x, b1x) AND greatest(a0y, a1y) >= least(b0y, b1y) AND least(a0y, a1y) <= greatest(b0y, b1y)")
_GAP = f"CASE WHEN {_MEET} THEN 0 ELSE least({_to_piece('a0x', 'a0y', 'b0', 'b1')}, {_to_piece('a1x', 'a1y', 'b0', 'b1')}, {_to_piece('b0x', 'b0y', 'a0', 'a1')}, {_to_piece('b1x', 'b1y', 'a0', 'a1')}) END"
_HEADING = "degrees(atan2({1}y - {0}y, {1}x - {0}x))"
_IN, _OUT = "(direction < 2 OR (direction = 2) <> {0})", "(direction < 2 OR (direction = 2) = {0})"

VIEW_SQL["bl_arms"] = f"""SELECT unit, road_id, CASE WHEN s THEN src ELSE dst END AS inside, CASE WHEN s THEN dst ELSE src END AS outside, {_IN.format('s')} AS goes_in, {_OUT.format('s')} AS goes_out,
    x0 AS a0x, y0 AS a0y, x1 AS a1x, y1 AS a1y, CASE WHEN s THEN degrees(atan2(y1 - y0, x1 - x0)) ELSE degrees(atan2(y0 - y1, x0 - x1)) END AS heading
    FROM (SELECT *, src % 8 IN (3, 6) AS s FROM block_edges WHERE (src % 8 IN (3, 6)) <> (dst % 8 IN (3, 6)))"""
_TARGET = "least(sqrt(pow({0}x - ({1}), 2) + pow({0}y - ({2}), 2)), sqrt(pow({0}x - ({3}), 2) + pow({0}y - ({4}), 2)))"
_BASE = "8 * unit"
VIEW_SQL["bl_arm_carriers"] = f"""SELECT unit, arm, road_id, inner_node, goes_in, goes_out, gap_m, anchor_m FROM (
    SELECT a.unit, a.road_id AS arm, c.road_id, CASE WHEN s THEN src ELSE dst END AS inner_node, {_IN.format('s')} AS goes_in, {_OUT.format('s')} AS goes_out, heading,
           CASE WHEN s THEN {_HEADING.format('b0', 'b1')} ELSE {_HEADING.format('b1', 'b0')} END AS other, least(d0, d1) AS anchor_m, {_GAP} AS gap_m
    FROM bl_arms a JOIN (SELECT *, struct_pack(d := d0, n := src) < struct_pack(d := d1, n := dst) AS s FROM (
        SELECT *, x0 AS b0x, y0 AS b0y, x1 AS b1x, y1 AS b1y, (SELECT min(sqrt(pow(x0 - {_NX.format('id')}, 2) + pow(y0 - {_NY.format('id')}, 2))) FROM net_nodes WHERE id IN (8 * unit + 3, 8 * unit + 6)) AS d0,
               (SELECT min(sqrt(pow(x1 - {_NX.format('id')}, 2) + pow(y1 - {_NY.format('id')}, 2))) FROM net_nodes WHERE id IN (8 * unit + 3, 8 * unit + 6)) AS d1 FROM block_carriers)) c ON c.unit = a.unit)
    WHERE gap_m <= {GAP_M} AND anchor_m <= {ANCHOR_M} AND least(abs(heading - other) % 360, 360 - abs(heading - other) % 360) <= {HEADING_DEG}"""
VIEW_SQL["bl_movements"] = """SELECT DISTINCT r.unit, r.arm AS in_road, o.road_id AS out_road FROM (
    WITH RECURSIVE r(unit, arm, node) AS (SELECT unit, road_id, outside FROM bl_arms WHERE goes_in UNION SELECT r.unit, r.arm, e.dst FROM r JOIN block_directed e ON e.unit = r.unit AND e.src = r.node) SELECT * FROM r) r
    JOIN bl_arms o ON o.unit = r.unit AND o.outside = r.node AND o.goes_out AND o.road_id <> r.arm"""
_AUDIT = """q(unit, arm, node) AS (SELECT unit, arm, inner_node FROM bl_arm_carriers WHERE goes_in UNION SELECT q.unit, q.arm, e.dst FROM q JOIN carrier_directed e ON e.unit = q.unit AND e.src = q.node),
    roles AS (SELECT unit, arm, bool_or(goes_in) AS i, bool_or(goes_out) AS o FROM bl_arm_carriers GROUP BY ALL),
    raw AS (SELECT DISTINCT q.unit, q.arm AS in_road, c.arm AS out_road FROM q JOIN bl_arm_carriers c ON c.unit = q.unit AND c.inner_node = q.node AND c.goes_out),
    ali AS (SELECT DISTINCT a.unit, a.arm AS in_road, b.arm AS out_road FROM bl_arm_carriers a JOIN bl_arm_carriers b ON a.unit = b.unit AND a.goes_in AND b.goes_out AND a.inner_node <> b.inner_node
            AND a.inner_node % 8 IN (3, 6) AND b.inner_node % 8 IN (3, 6) WHERE a.unit % 2 = 0),
    audited AS (SELECT m.unit, m.in_road, m.out_road, x.unit IS NULL OR y.unit IS NULL AS unmapped, coalesce(x.i AND y.o, false) AS fits, raw.unit IS NOT NULL AS raw, ali.unit IS NOT NULL AS ali FROM bl_movements m
            LEFT JOIN roles x ON x.unit = m.unit AND x.arm = m.in_road LEFT JOIN roles y ON y.unit = m.unit AND y.arm = m.out_road LEFT JOIN raw ON raw.unit = m.unit AND raw.in_road = m.in_road AND raw.out_road = m.out_road LEFT JOIN ali ON ali.unit = m.unit AND ali.in_road = m.in_road AND ali.out_road = m.out_road),
    told AS (SELECT unit, in_road, out_road, CASE WHEN unmapped THEN 'insufficient_boundary_mapping' WHEN fits AND (raw OR ali) THEN 'equivalent' ELSE 'missing' END AS status,
            CASE WHEN unmapped OR NOT fits THEN '' WHEN raw THEN 'raw_local_directed_carrier' WHEN ali THEN 'canonical_raw_alias_portal' ELSE '' END AS basis,
            CASE WHEN unmapped THEN 'boundary_carrier_not_locally_anchored' WHEN NOT fits THEN 'boundary_direction_role_missing' WHEN raw OR ali THEN '' ELSE 'internal_directed_carrier_missing' END AS reason FROM audited)"""


def movement_inputs(v):
    roads, targets = block_edges(v), members(v).select("unit", node_x(F.col("node")).alias("x"), node_y(F.col("node")).alias("y"))
    arms = M.boundary_arms(roads, members(v))
    centres = targets.groupBy("unit").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    carriers = M.local_carriers(centres, block_carriers(v).drop("unit", "length_m"), LOCAL_M)
    nodes = carrier_nodes(v)
    found = GR.cut(M.arm_carriers(arms, carriers, nodes, targets, GAP_M, ANCHOR_M, HEADING_DEG))
    return roads, arms, carriers, nodes, found


def audited_movements(v):
    roads, arms, carriers, nodes, found = movement_inputs(v)
    return GR.cut(M.audit_movements(M.required_movements(roads, arms), found, carriers, M.alias_portals(found, nodes, zones(v), ENDPOINT_M)))


@query("arm_carrier_mapping", "SELECT unit, arm, road_id, inner_node, goes_in, goes_out, round(gap_m, 6) AS gap_m, round(anchor_m, 6) AS anchor_m FROM bl_arm_carriers")
def _(v):
    found = movement_inputs(v)[-1]
    return found.select("unit", "arm", "road_id", F.col("inner").alias("inner_node"), "goes_in", "goes_out", rounded(F.col("gap_m")).alias("gap_m"), rounded(F.col("anchor_m")).alias("anchor_m"))


@query("required_movements_audit", f"WITH {_AUDIT} SELECT * FROM told")
def _(v):
    return audited_movements(v)


@query("junction_movement_verdict", f"""WITH {_AUDIT}, u AS (SELECT DISTINCT (id - 1) // 8 AS unit FROM net_nodes WHERE id % 8 IN (3, 6)),
    c AS (SELECT u.unit, count(status) AS required, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'insufficient_boundary_mapping') AS incomplete FROM u LEFT JOIN told USING (unit) GROUP BY 1)
    SELECT *, CASE WHEN required = 0 OR (incomplete > 0 AND missing = 0) THEN 'insufficient' WHEN missing > 0 THEN 'confirmed_missing' ELSE 'equivalent' END AS status FROM c""")
def _(v):
    return M.junction_verdicts(audited_movements(v), members(v))


# -- gaps explained, owners, variants -------------------------------------------------------------------------------------------------------------

def block_ends(v):
    return v.net_nodes.where((F.col("id") % 8 == 1) & (F.col("id") + 6 <= v.n_customer)).select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("a"), (F.col("id") + 6).alias("b"))


_ENDS = "ends AS (SELECT (id - 1) // 8 AS unit, id AS a, id + 6 AS b FROM net_nodes WHERE id % 8 = 1 AND id + 6 <= (SELECT count(*) FROM customer))"
_LEVELS = f"""z AS (SELECT id AS node, (id - 1) // 8 AS unit FROM net_nodes WHERE ((id - 1) // 8) % 2 = 0 AND id % 8 IN (2, 5, 7)),
    steps AS (SELECT unit, src, dst, road_id, CAST(length_m AS DOUBLE) AS m, 0 AS level FROM carrier_directed UNION ALL
        SELECT (a.id - 1) // 8, a.id, b.id, NULL, sqrt(pow({_NX.format('a.id')} - {_NX.format('b.id')}, 2) + pow({_NY.format('a.id')} - {_NY.format('b.id')}, 2)), 1 FROM net_nodes a JOIN net_nodes b
        ON (a.id % 8 = 3 AND b.id = a.id + 3) OR (a.id % 8 = 6 AND b.id = a.id - 3) UNION ALL
        SELECT a.unit, a.node, b.node, NULL, 0, 2 FROM z a JOIN z b ON a.unit = b.unit AND a.node <> b.node)"""


@query("semantic_surface_exclusion", f"""WITH {_ENDS}, {_LEVELS},
    p(unit, node, m, level, seen) AS (SELECT unit, a, 0::DOUBLE, 0, [a] FROM ends UNION ALL SELECT p.unit, s.dst, p.m + s.m, greatest(p.level, s.level), list_append(seen, s.dst) FROM p JOIN steps s ON s.unit = p.unit AND s.src = p.node
        WHERE NOT list_contains(seen, s.dst)),
    best AS (SELECT unit, node, min(struct_pack(l := level, m := m)) AS k FROM p GROUP BY ALL)
    SELECT e.unit, a, b, coalesce(['raw_carrier', 'alias_carrier', 'surface_carrier'][k.l + 1], 'none') AS explained_by, round(k.m, 6) AS length_m, coalesce(k.m <= 1.5 * 60 AND k.m - 60 <= 100, false) AS accepted
    FROM ends e LEFT JOIN best ON best.unit = e.unit AND best.node = e.b""")
def _(v):
    nodes = carrier_nodes(v).withColumn("unit", F.floor((F.col("node") - 1) / 8))
    held = nodes.where((F.col("unit") % 2 == 0) & (F.col("node") % 8).isin(2, 5, 7)).select("unit", "node", F.col("unit").alias("surface_id"))
    rows, _ = M.explain_gaps(block_carriers(v).select("unit", "src", "dst", "road_id", "direction", "length_m"), nodes, held, block_ends(v).withColumn("reference_m", F.lit(60.0)), ENDPOINT_M)
    return rows.withColumn("length_m", rounded(F.col("length_m")))


@query("nearest_owner_nodes", """WITH o AS (SELECT id AS node, id % 5 AS owner FROM net_nodes WHERE id % 8 IN (1, 6)), p(node, owner, m) AS (SELECT node, owner, 0::BIGINT FROM o UNION
    SELECT e.dst, p.owner, p.m + e.length_m FROM p JOIN block_both e ON e.src = p.node WHERE p.m + e.length_m <= 30)
    SELECT node, CAST((min(struct_pack(m := m, o := owner))).o AS BIGINT) AS owner, CAST((min(struct_pack(m := m, o := owner))).m AS DOUBLE) AS dist_m FROM p GROUP BY node""")
def _(v):
    owners = v.net_nodes.where((F.col("id") % 8).isin(1, 6)).select(F.col("id").alias("node"), (F.col("id") % 5).alias("owner"))
    return S.nearest_owners(GR.both_ways(block_edges(v).select("src", "dst", "length_m")), owners, 30.0)


_PARTS = """pe AS (SELECT unit, src, dst FROM block_carriers WHERE road_id % 2 = 1 UNION SELECT unit, dst, src FROM block_carriers WHERE road_id % 2 = 1),
    pr(unit, node, other) AS (SELECT unit, src, src FROM pe UNION SELECT pr.unit, pr.node, pe.dst FROM pr JOIN pe ON pe.unit = pr.unit AND pe.src = pr.other), part AS (SELECT unit, node, min(other) AS component FROM pr GROUP BY ALL)"""
_D_START = "sqrt(pow(px - b0x, 2) + pow(py - b0y, 2))"
_OWN = f"""{_PARTS}, deg AS (SELECT unit, node, count(DISTINCT road_id) AS n FROM (SELECT unit, road_id, unnest([src, dst]) AS node FROM block_carriers WHERE road_id % 2 = 1) GROUP BY ALL),
    t AS (SELECT id AS target, (id - 1) // 8 AS unit, {_NX.format('id')} AS tx, {_NY.format('id')} AS ty FROM net_nodes WHERE id % 8 IN (3, 6)),
    d AS (SELECT t.*, road_id, src, dst, x0 AS b0x, y0 AS b0y, x1 AS b1x, y1 AS b1y, {_to_piece('tx', 'ty', 'c.b0', 'c.b1')} AS dist FROM t JOIN (SELECT *, x0 AS b0x, y0 AS b0y, x1 AS b1x, y1 AS b1y FROM block_carriers WHERE road_id % 2 = 1) c ON c.unit = t.unit),
    n AS (SELECT unit, target, min(struct_pack(d := dist, r := road_id)) AS k FROM d GROUP BY ALL),
    j AS (SELECT d.*, greatest(0.0, least(1.0, ((tx - b0x) * (b1x - b0x) + (ty - b0y) * (b1y - b0y)) / (pow(b1x - b0x, 2) + pow(b1y - b0y, 2)))) AS f FROM d JOIN n ON n.unit = d.unit AND n.target = d.target AND k.r = road_id),
    e AS (SELECT *, f * sqrt(pow(b1x - b0x, 2) + pow(b1y - b0y, 2)) AS s, (1 - f) * sqrt(pow(b1x - b0x, 2) + pow(b1y - b0y, 2)) AS z FROM j),
    g AS (SELECT t.unit, t.target, e.road_id, e.dist, part.component, CASE WHEN least(s, z) <= 8 THEN CASE WHEN s <= z THEN src ELSE dst END END AS endpoint FROM t LEFT JOIN e USING (unit, target) LEFT JOIN part ON part.unit = t.unit AND part.node = e.src),
    own AS (SELECT g.*, deg.n AS endpoint_degree, CASE WHEN road_id IS NULL THEN 'missing' WHEN endpoint IS NULL THEN 'interior' WHEN deg.n >= 2 THEN 'shared_endpoint' ELSE 'terminal_endpoint' END AS mode,
            coalesce(dist <= 5, false) AS near FROM g LEFT JOIN deg ON deg.unit = g.unit AND deg.node = g.endpoint)"""


def owned(v):
    targets = v.net_nodes.where((F.col("id") % 8).isin(3, 6)).select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("target"), node_x(F.col("id")).alias("x"), node_y(F.col("id")).alias("y"))
    return M.support_ownership(targets, block_carriers(v).where(F.col("road_id") % 2 == 1).select("unit", "road_id", "src", "dst", "pts"), 5.0, 8.0)


@query("support_ownership", f"WITH {_OWN} SELECT unit, target, road_id, round(dist, 6) AS distance_m, component, mode, endpoint, endpoint_degree, near FROM own")
def _(v):
    return owned(v)[0].withColumn("distance_m", rounded(F.col("distance_m")))


@query("support_ownership_issues", f"""WITH {_OWN}, pc AS (SELECT unit, count(DISTINCT component) AS components FROM part GROUP BY 1), b AS (SELECT unit, count(*) AS n, count(DISTINCT component) AS owned, bool_or(near) AS any_near,
    count(*) FILTER (mode = 'terminal_endpoint') AS terminal, count(DISTINCT endpoint) FILTER (mode = 'terminal_endpoint') AS terminals, bool_or(mode = 'missing') AS missing FROM own GROUP BY 1)
    SELECT b.unit, coalesce(components, 0) AS components, concat_ws(',', CASE WHEN missing THEN 'support_carrier_missing' END, CASE WHEN components = 1 AND n >= 2 AND NOT any_near THEN 'target_outside_local_support_ownership' END,
    CASE WHEN components = 1 AND n >= 2 AND terminal = n AND terminals = 1 THEN 'target_projects_to_terminal_support_endpoint' END,
    CASE WHEN owned > 1 AND components > greatest(2, n) THEN 'targets_project_to_disconnected_support_components' END) AS issues FROM b LEFT JOIN pc USING (unit)""")
def _(v):
    return owned(v)[1]


_LIMIT = 45


@query("branch_variants", f"""WITH {_ENDS}, p(unit, node, b, m, roads, nodes) AS (SELECT unit, a, b, 0::BIGINT, []::BIGINT[], [a] FROM ends UNION ALL SELECT p.unit, e.dst, p.b, p.m + e.length_m, list_append(roads, e.road_id), list_append(nodes, e.dst)
    FROM p JOIN block_both e ON e.unit = p.unit AND e.src = p.node WHERE p.node <> p.b AND NOT list_contains(nodes, e.dst) AND p.m + e.length_m <= {_LIMIT}),
    k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY m, roads) AS rank FROM p WHERE node = b)
    SELECT unit, CAST(rank AS INTEGER) AS rank, CAST(m AS DOUBLE) AS m, array_to_string(nodes, '-') AS path FROM k WHERE rank <= 3""")
def _(v):
    found = A.branch_variants(GR.both_ways(block_edges(v).select("unit", "src", "dst", "road_id", "length_m")), block_ends(v), 3, float(_LIMIT))
    return found.select("unit", "rank", "m", F.array_join("nodes", "-").alias("path"))


# -- evidence along axes --------------------------------------------------------------------------------------------------------------------------

VIEW_SQL["bl_evidence"] = "SELECT l_orderkey AS unit, l_linenumber::BIGINT AS piece, l_partkey * 37 % 80000 AS low, l_partkey * 37 % 80000 + CAST(l_quantity AS BIGINT) * 700 AS high FROM lineitem"


def evidence(v):
    low = F.col("l_partkey") * 37 % 80000
    return v.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").cast("bigint").alias("piece"), low.alias("low"), (low + F.col("l_quantity").cast("bigint") * 700).alias("high"))


@query("corridor_assembly", """WITH e AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY piece, low, high) AS piece, low, high FROM bl_evidence), marks AS (SELECT unit, low AS pt FROM e UNION SELECT unit, high FROM e),
    steps AS (SELECT unit, pt, lead(pt) OVER (PARTITION BY unit ORDER BY pt) AS z FROM marks), cov AS (SELECT s.unit, sum(z - pt) AS mm FROM steps s WHERE z IS NOT NULL AND EXISTS (SELECT 1 FROM e WHERE e.unit = s.unit AND low <= pt AND high >= z) GROUP BY 1),
    used AS (SELECT e.*, least(1.0, mm / 100000) AS coverage FROM e JOIN cov USING (unit) WHERE mm / 100000 + 1e-9 >= 0.5),
    arc AS (SELECT a.unit, a.piece AS s, b.piece AS d FROM used a JOIN used b ON a.unit = b.unit AND a.piece <> b.piece AND abs(b.low - a.high) <= 12000),
    r(unit, s, d) AS (SELECT unit, piece, piece FROM used UNION SELECT r.unit, r.s, arc.d FROM r JOIN arc ON arc.unit = r.unit AND arc.s = r.d),
    comp AS (SELECT x.unit, x.s AS piece, min(x.d) AS c FROM r x JOIN r y ON x.unit = y.unit AND x.s = y.d AND x.d = y.s GROUP BY ALL),
    w AS (SELECT unit, c, sum(high - low) AS w FROM comp JOIN used USING (unit, piece) GROUP BY ALL), link AS (SELECT DISTINCT arc.unit, x.c AS s, y.c AS d FROM arc JOIN comp x ON x.unit = arc.unit AND x.piece = s JOIN comp y ON y.unit = arc.unit AND y.piece = d WHERE x.c <> y.c),
    p(unit, c, t, path) AS (SELECT unit, c, w::BIGINT, [c] FROM w UNION ALL SELECT p.unit, l.d, (p.t + w.w)::BIGINT, list_prepend(l.d, p.path) FROM p JOIN link l ON l.unit = p.unit AND l.s = p.c JOIN w ON w.unit = p.unit AND w.c = l.d),
    best AS (SELECT unit, min(struct_pack(t := -t, p := path)) AS k FROM p GROUP BY 1), m AS (SELECT u.unit, u.piece, u.low, u.high, coverage, len(k.p) - list_position(k.p, c) AS chain_no FROM used u JOIN comp USING (unit, piece) JOIN best USING (unit) WHERE list_contains(k.p, c)),
    mm AS (SELECT unit, low AS pt FROM m UNION SELECT unit, high FROM m), ms AS (SELECT unit, pt, lead(pt) OVER (PARTITION BY unit ORDER BY pt) AS z FROM mm),
    obs AS (SELECT s.unit, sum(z - pt) AS mm FROM ms s WHERE z IS NOT NULL AND EXISTS (SELECT 1 FROM m WHERE m.unit = s.unit AND low <= pt AND high >= z) GROUP BY 1)
    SELECT m.unit, string_agg(piece::VARCHAR, ',' ORDER BY chain_no, low, piece) AS pieces, CAST(any_value(mm) AS BIGINT) AS observed_mm, round(any_value(coverage), 6) AS coverage, round(1 - any_value(mm) / (max(high) - min(low)), 6) AS completion,
    CASE WHEN count(*) = 1 THEN 'single_patch_observation' WHEN any_value(mm) < max(high) - min(low) THEN 'observed_chain_with_constrained_completion' ELSE 'multi_patch_median_corridor' END AS state FROM m JOIN obs USING (unit) GROUP BY m.unit""")
def _(v):
    from pyspark.sql import Window
    pieces = evidence(v).withColumn("piece", F.row_number().over(Window.partitionBy("unit").orderBy("piece", "low", "high")).cast("bigint"))
    axes = pieces.select("unit").distinct().withColumn("length_mm", F.lit(100_000).cast("long"))
    made = A.assemble_corridors(pieces, axes, 12_000, 0.5)
    return made.select("unit", F.array_join("pieces", ",").alias("pieces"), "observed_mm", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("completion")).alias("completion"), "state")


_CLAIMS = "claims AS (SELECT l_partkey + 1 AS road_id, l_orderkey * 13 % 90000 AS low, l_orderkey * 13 % 90000 + CAST(l_quantity AS BIGINT) * 600 AS high, CAST(l_tax * 100 AS INTEGER) AS score, l_suppkey + 1 AS segment_id, l_linenumber::BIGINT AS member_id FROM lineitem)"


@query("target_fragments", f"""WITH {_CLAIMS}, roads AS (SELECT p_partkey + 1 AS road_id, 60000 + p_partkey % 50 * 1000 AS length_mm FROM part), c AS (SELECT road_id, greatest(low, 0) AS low, least(high, length_mm) AS high, score, segment_id, member_id FROM claims JOIN roads USING (road_id)),
    marks AS (SELECT road_id, unnest([low, high]) AS pt FROM c WHERE low < high UNION SELECT road_id, unnest([0, length_mm]) FROM roads), steps AS (SELECT * FROM (SELECT road_id, pt, lead(pt) OVER (PARTITION BY road_id ORDER BY pt) AS z FROM marks) WHERE z IS NOT NULL),
    best AS (SELECT s.road_id, pt, z, min(struct_pack(s := score, g := segment_id, m := member_id)) AS k FROM steps s JOIN c ON c.road_id = s.road_id AND low <= pt AND high >= z GROUP BY ALL),
    f AS (SELECT *, CASE WHEN lag(z) OVER w IS NULL THEN 0 WHEN lag(z) OVER w <> pt OR lag(k.g) OVER w <> k.g OR lag(k.m) OVER w <> k.m THEN 1 ELSE 0 END AS step FROM best WINDOW w AS (PARTITION BY road_id ORDER BY pt)),
    n AS (SELECT *, sum(step) OVER (PARTITION BY road_id ORDER BY pt) AS fragment_no FROM f)
    SELECT road_id, CAST(fragment_no AS BIGINT) AS fragment_no, min(pt) AS low, max(z) AS high, k.g AS segment_id, k.m AS member_id, min(k.s) AS score FROM n GROUP BY road_id, fragment_no, k.g, k.m HAVING max(z) - min(pt) >= 2000""")
def _(v):
    low = F.col("l_orderkey") * 13 % 90000
    claims = v.lineitem.select((F.col("l_partkey") + 1).alias("road_id"), low.alias("low"), (low + F.col("l_quantity").cast("bigint") * 600).alias("high"), F.round(F.col("l_tax") * 100).cast("int").alias("score"),
                               (F.col("l_suppkey") + 1).alias("segment_id"), F.col("l_linenumber").cast("bigint").alias("member_id"))
    roads = v.part.select((F.col("p_partkey") + 1).alias("road_id"), (60000 + F.col("p_partkey") % 50 * 1000).alias("length_mm"))
    return A.target_fragments(claims, roads, 2000)


@query("partial_members", f"""WITH {_CLAIMS}, m AS (SELECT p_partkey + 1 AS member_id, CAST(p_size % 4 AS INTEGER) AS direction, 60000 + p_partkey % 50 * 1000 AS length_mm, p_partkey % 3 <> 0 AS s, p_partkey % 5 <> 0 AS e FROM part),
    c AS (SELECT m.member_id, greatest(low, 0) AS low, least(high, length_mm) AS high FROM claims JOIN m ON m.member_id = road_id WHERE score < 1), r AS (SELECT * FROM c WHERE low < high), marks AS (SELECT member_id, unnest([low, high]) AS pt FROM r),
    d AS (SELECT DISTINCT * FROM marks), steps AS (SELECT member_id, pt, lead(pt) OVER (PARTITION BY member_id ORDER BY pt) AS z FROM d), cov AS (SELECT s.member_id, sum(z - pt) AS mm FROM steps s WHERE z IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.member_id = s.member_id AND low <= pt AND high >= z) GROUP BY 1),
    h AS (SELECT m.*, mm, (SELECT min(low) FROM r WHERE r.member_id = m.member_id) AS low, (SELECT max(high) FROM r WHERE r.member_id = m.member_id) AS high FROM m JOIN cov USING (member_id) WHERE direction IN (2, 3) AND mm / length_mm + 1e-9 >= 0.5 AND mm / length_mm + 1e-9 < 0.95),
    g AS (SELECT *, CASE WHEN s AND low <= 20000 THEN 0 ELSE low END AS l, CASE WHEN e AND length_mm - high <= 20000 THEN 0 ELSE length_mm - high END AS t FROM h), k AS (SELECT * FROM g WHERE NOT (l > 0 AND l < 1000) AND NOT (t > 0 AND t < 1000))
    SELECT member_id, 'built' AS part, l AS low, length_mm - t AS high FROM k UNION ALL SELECT member_id, 'retained_prefix', 0, l FROM k WHERE l > 0 UNION ALL SELECT member_id, 'retained_suffix', length_mm - t, length_mm FROM k WHERE t > 0""")
def _(v):
    p = F.col("p_partkey")
    members_ = v.part.select((p + 1).alias("member_id"), (F.col("p_size") % 4).cast("int").alias("direction"), (60000 + p % 50 * 1000).alias("length_mm"), (p % 3 != 0).alias("start_on_surface"), (p % 5 != 0).alias("end_on_surface"))
    low = F.col("l_orderkey") * 13 % 90000
    seen = v.lineitem.where(F.round(F.col("l_tax") * 100) < 1).select((F.col("l_partkey") + 1).alias("member_id"), low.alias("low"), (low + F.col("l_quantity").cast("bigint") * 600).alias("high"))
    return A.partial_members(members_, seen, 0.95)


@query("fork_binding")
def _(v):
    from ..operators.spatial import distance_join
    forks = v.net_nodes.where(F.col("kind_2").isin(8, 16)).select(F.col("id").alias("unit"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("grade_2").alias("priority"))
    places = v.surfaces.select("surface_id", ((F.col("x0") + F.col("x1")) / 2).alias("rx"), ((F.col("y0") + F.col("y1")) / 2).alias("ry"))
    near = distance_join(forks, places, 60.0)
    far = F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2)
    return A.bind_forks(near.select("unit", "surface_id", "priority", far.alias("distance_m")))
