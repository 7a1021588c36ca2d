"""Graph operators; chains of at most eight nodes keep the recursive SQL cheap, whatever the scale."""
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as GR
from ..operators import joins as J
from ..operators import search as SE
from .joins import canon_roads, relation_last
from .registry import query
from .views import VIEW_SQL
from .windows import turn_sides

VIEW_SQL["chain_edges"] = """SELECT id AS road_id, (id - 1) // 8 AS unit, snodeid AS src, enodeid AS dst, length_m, direction, formway, roadtype FROM net_chain_roads UNION ALL
    SELECT 10000000000 + id, (id - 1) // 8, id, id + 5, 40 + id % 7, 0, 0, 0 FROM net_nodes WHERE id % 16 = 1 AND id + 5 <= (SELECT count(*) FROM customer)"""
VIEW_SQL["chain_directed"] = """SELECT road_id, unit, src, dst, length_m FROM chain_edges WHERE direction <> 3 UNION ALL
    SELECT road_id, unit, dst, src, length_m FROM chain_edges WHERE direction <> 2"""
VIEW_SQL["chain_both"] = """SELECT road_id, unit, src, dst, length_m FROM chain_edges UNION ALL SELECT road_id, unit, dst, src, length_m FROM chain_edges"""


def chain_edges(v):
    extra = v.net_nodes.where((F.col("id") % 16 == 1) & (F.col("id") + 5 <= v.n_customer)).select(
        (F.col("id") + 10_000_000_000).alias("road_id"), F.col("id").alias("src"), (F.col("id") + 5).alias("dst"),
        (F.col("id") % 7 + 40).alias("length_m"), F.lit(0).alias("direction"), F.lit(0).alias("formway"), F.lit(0).alias("roadtype"))
    base = v.net_chain_roads.select(F.col("id").alias("road_id"), F.col("snodeid").alias("src"), F.col("enodeid").alias("dst"),
                                    "length_m", "direction", "formway", "roadtype")
    unit = F.when(F.col("road_id") > 10_000_000_000, F.floor((F.col("src") - 1) / 8)).otherwise(F.floor((F.col("road_id") - 1) / 8))
    return base.unionByName(extra).withColumn("unit", unit)


def components_sql(where: str = "") -> str:
    """Recursive components over part of the chain edges."""
    return f"""e AS (SELECT src, dst FROM chain_edges {where} UNION SELECT dst, src FROM chain_edges {where}),
    r(node, other) AS (SELECT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.other),
    comp AS (SELECT node, min(other) AS component FROM r GROUP BY node)"""


@query("directed_edges", """SELECT id AS road_id, src, dst FROM canon_roads WHERE direction <> 3 UNION ALL SELECT id, dst, src FROM canon_roads WHERE direction <> 2""")
def _(v):
    roads = canon_roads(v).select(F.col("id").alias("road_id"), "src", "dst", "direction")
    return GR.directed_edges(roads).select("road_id", "src", "dst")


@query("connected_components", f"WITH {components_sql()} SELECT node, component FROM comp")
def _(v):
    return GR.connected_components(chain_edges(v))


@query("roundabout_groups", f"""WITH {components_sql('WHERE roadtype & 8 <> 0')} SELECT node, component AS mainnodeid, CASE WHEN count(*) OVER (PARTITION BY component) > 1
    THEN 64 END AS kind_2 FROM comp""")
def _(v):
    from ..plans.preprocess import roundabout_nodes
    return roundabout_nodes(chain_edges(v))


@query("advance_right_components", f"""WITH {components_sql('WHERE formway & 128 <> 0')}, m AS (SELECT component, road_id FROM chain_edges JOIN comp ON node = src WHERE formway & 128 <> 0)
    SELECT road_id, 'advance_right_' || substr(sha1(string_agg(CAST(road_id AS VARCHAR), chr(31)) OVER (PARTITION BY component ORDER BY road_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 16)
    AS segment_id FROM m""")
def _(v):
    from ..plans.segment import advance_right_segments
    return advance_right_segments(chain_edges(v))


_SOURCES = "SELECT id AS node, id AS unit FROM net_nodes WHERE id % 8 IN (1, 5)"


def chain_sources(v):
    return v.net_nodes.where((F.col("id") % 8).isin(1, 5)).select(F.col("id").alias("unit"), F.col("id").alias("node"))


@query("multi_source_shortest_path", f"""WITH s AS ({_SOURCES}), p(unit, node, d, seen) AS (SELECT unit, node, 0::BIGINT, [node] FROM s UNION ALL SELECT p.unit, e.dst, p.d + e.length_m,
    list_append(p.seen, e.dst) FROM p JOIN chain_directed e ON e.src = p.node WHERE NOT list_contains(p.seen, e.dst) AND p.d + e.length_m <= 60)
    SELECT unit, node, CAST(min(d) AS DOUBLE) AS dist_m FROM p GROUP BY unit, node""")
def _(v):
    edges = GR.directed_edges(chain_edges(v).drop("unit"))
    return GR.shortest_distances(edges, chain_sources(v), 60.0).select("unit", "node", "dist_m")


def end_pairs(v):
    """First and last node of every block of eight."""
    return v.net_nodes.where((F.col("id") % 8 == 1) & (F.col("id") + 5 <= v.n_customer)).select(
        F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("a"), (F.col("id") + 5).alias("b"))


_PAIRS = "pairs AS (SELECT (id - 1) // 8 AS unit, id AS a, id + 5 AS b FROM net_nodes WHERE id % 8 = 1 AND id + 5 <= (SELECT count(*) FROM customer))"


@query("reachability_directed", f"""WITH {_PAIRS}, r(unit, node) AS (SELECT unit, a FROM pairs UNION SELECT r.unit, e.dst FROM r JOIN chain_directed e ON e.src = r.node AND e.unit = r.unit)
    SELECT p.unit, a, b, r.node IS NOT NULL AS reached FROM pairs p LEFT JOIN r ON r.unit = p.unit AND r.node = p.b""")
def _(v):
    return GR.pairs_reachable(GR.directed_edges(chain_edges(v)), end_pairs(v))


@query("reachability_undirected", f"""WITH {_PAIRS}, {components_sql()} SELECT unit, a, b, x.component = y.component AS connected FROM pairs JOIN comp x ON x.node = a JOIN comp y ON y.node = b""")
def _(v):
    comp = GR.unit_components(chain_edges(v))
    a = comp.select("unit", F.col("node").alias("a"), F.col("component").alias("_a"))
    b = comp.select("unit", F.col("node").alias("b"), F.col("component").alias("_b"))
    return end_pairs(v).join(a, ["unit", "a"]).join(b, ["unit", "b"]).select("unit", "a", "b", (F.col("_a") == F.col("_b")).alias("connected"))


@query("required_directions", f"""WITH {_PAIRS}, f(unit, node) AS (SELECT unit, a FROM pairs UNION SELECT f.unit, e.dst FROM f JOIN chain_directed e ON e.src = f.node AND e.unit = f.unit),
    g(unit, node) AS (SELECT unit, b FROM pairs UNION SELECT g.unit, e.dst FROM g JOIN chain_directed e ON e.src = g.node AND e.unit = g.unit)
    SELECT p.unit, concat_ws(',', CASE WHEN f.node IS NOT NULL THEN 'pair0_to_pair1' END, CASE WHEN g.node IS NOT NULL THEN 'pair1_to_pair0' END) AS directions FROM pairs p
    LEFT JOIN f ON f.unit = p.unit AND f.node = p.b LEFT JOIN g ON g.unit = p.unit AND g.node = p.a""")
def _(v):
    from ..plans.quality import required_directions
    return required_directions(GR.directed_edges(chain_edges(v)), end_pairs(v)).select("unit", "directions")


@query("bridge_edges", """WITH r(road_id, target, node) AS (SELECT road_id, dst, src FROM chain_edges UNION SELECT r.road_id, r.target, e.dst FROM r JOIN chain_both e ON e.src = r.node AND e.road_id <> r.road_id)
    SELECT road_id FROM chain_edges WHERE road_id NOT IN (SELECT road_id FROM r WHERE node = target)""")
def _(v):
    return GR.bridge_edges(chain_edges(v))


@query("through_node_chain", """WITH r(seed, node) AS (SELECT id, id FROM net_nodes WHERE id % 8 IN (1, 4, 7) UNION SELECT r.seed, e.dst FROM r JOIN chain_directed e ON e.src = r.node
    WHERE r.node = r.seed OR r.node % 8 NOT IN (1, 4, 7)), h AS (SELECT seed AS a, node AS b FROM r WHERE seed <> node AND node % 8 IN (1, 4, 7))
    SELECT h.a, h.b FROM h JOIN h k ON k.a = h.b AND k.b = h.a WHERE h.a < h.b""")
def _(v):
    seeds = v.net_nodes.where((F.col("id") % 8).isin(1, 4, 7)).select(F.col("id").alias("node"))
    through = v.net_nodes.where(~(F.col("id") % 8).isin(1, 4, 7)).select(F.col("id").alias("node"))
    return GR.through_pairs(GR.directed_edges(chain_edges(v)), seeds, seeds, through)


@query("degree2_contract", """WITH n AS (SELECT node, min(road_id) AS a, max(road_id) AS b FROM (SELECT road_id, unnest([src, dst]) AS node FROM chain_edges) GROUP BY node HAVING count(*) = 2),
    t AS (SELECT a, b FROM n UNION SELECT b, a FROM n), r(road_id, other) AS (SELECT road_id, road_id FROM chain_edges UNION SELECT r.road_id, t.b FROM r JOIN t ON t.a = r.other)
    SELECT road_id, min(other) AS chain_id FROM r GROUP BY road_id""")
def _(v):
    return GR.contract_chains(chain_edges(v))


@query("chain_edges_divmerge")
def _(v):
    from ..plans.preprocess import divmerge_chain_edges
    kinds = v.net_nodes.select(F.col("id").alias("node"), "kind_2")
    roads = canon_roads(v).select(F.col("id").alias("road_id"), "src", "dst", "direction", (F.col("id") % 90).cast("double").alias("length_m"))
    return divmerge_chain_edges(roads, kinds, 50.0, 80.0)


_TOPO = "SELECT road_id, src, dst, length_m FROM chain_edges WHERE road_id % 3 <> 0 UNION ALL SELECT 20000000000 + id, id + 3, id, 5 FROM net_nodes WHERE id % 24 = 1 AND id + 3 <= (SELECT count(*) FROM customer)"


@query("topo_offsets")
def _(v):
    forward = chain_edges(v).where(F.col("road_id") % 3 != 0).select("road_id", "src", "dst", "length_m")
    back = v.net_nodes.where((F.col("id") % 24 == 1) & (F.col("id") + 3 <= v.n_customer)).select(
        (F.col("id") + 20_000_000_000).alias("road_id"), (F.col("id") + 3).alias("src"), F.col("id").alias("dst"), F.lit(5).cast("bigint").alias("length_m"))
    return GR.topo_offsets(forward.unionByName(back))


@query("leaf_pruning", """SELECT road_id FROM chain_edges WHERE unit % 2 = 0 AND unit IN (SELECT unit FROM chain_edges WHERE road_id > 10000000000) AND (road_id > 10000000000 OR src % 8 BETWEEN 1 AND 5)""")
def _(v):
    return GR.prune_leaves(chain_edges(v)).select("road_id")


@query("component_select", f"""WITH {components_sql('WHERE formway & 128 = 0')} SELECT component, count(*) AS nodes, CAST(count_if(node % 4 = 1) AS BIGINT) AS required_nodes FROM comp GROUP BY component
    HAVING count_if(node % 4 = 1) >= 2""")
def _(v):
    comp = GR.connected_components(chain_edges(v).where(F.col("formway").bitwiseAND(128) == 0))
    return comp.groupBy("component").agg(F.count("*").alias("nodes"), F.count_if(F.col("node") % 4 == 1).alias("required_nodes")).where("required_nodes >= 2")


@query("enumerate_simple_paths", """WITH p(unit, node, nodes, m) AS (SELECT (id - 1) // 8, id, [id], 0::BIGINT FROM net_nodes WHERE id % 8 = 1 UNION ALL
    SELECT p.unit, e.dst, list_append(p.nodes, e.dst), p.m + e.length_m FROM p JOIN chain_both e ON e.src = p.node AND e.unit = p.unit WHERE p.m + e.length_m <= 60 AND NOT list_contains(p.nodes, e.dst)),
    c AS (SELECT DISTINCT p.unit FROM p JOIN chain_both e ON e.src = p.node AND e.unit = p.unit WHERE p.m + e.length_m > 60 AND NOT list_contains(p.nodes, e.dst))
    SELECT unit, array_to_string(nodes, '-') AS path, len(nodes) - 1 AS edges, CAST(m AS DOUBLE) AS length_m, unit IN (SELECT unit FROM c) AS cut FROM p WHERE len(nodes) > 1""")
def _(v):
    starts = v.net_nodes.where(F.col("id") % 8 == 1).select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("node"))
    paths, over = SE.paths_within(GR.both_ways(chain_edges(v).select("unit", "src", "dst", "road_id", "length_m")), starts, 60.0)
    return paths.join(over.withColumn("cut", F.lit(True)), "unit", "left").select(
        "unit", F.array_join("nodes", "-").alias("path"), F.size("roads").cast("bigint").alias("edges"), "length_m", F.coalesce("cut", F.lit(False)).alias("cut"))


@query("oneway_trace")
def _(v):
    from ..plans.segment import oneway_trace
    incoming, outgoing = turn_sides(v)
    stops = v.net_nodes.where(F.col("kind_2").isin(4, 64)).select(F.col("id").alias("junction_id"))
    return oneway_trace(canon_roads(v), incoming, outgoing, stops)


@query("graph_consumable", """WITH m AS (SELECT coalesce(nullif(mainnodeid, 0), -id) AS g, id FROM net_nodes), i AS (SELECT snodeid AS id FROM net_roads UNION SELECT enodeid FROM net_roads),
    g AS (SELECT mainnodeid AS base_id, bool_or(id IN (SELECT id FROM i)) AS any_incident FROM net_nodes WHERE mainnodeid IS NOT NULL AND mainnodeid <> 0 GROUP BY 1)
    SELECT target_id, r.base_id, CASE WHEN status <> 0 THEN 'relation_not_success' WHEN r.base_id <= 0 THEN 'success_relation_missing_base_id'
    WHEN n.id IS NOT NULL AND i.id IS NOT NULL THEN 'base_node_graph_incident' WHEN n.id IS NOT NULL AND g.any_incident THEN 'base_node_group_graph_incident'
    WHEN n.id IS NOT NULL THEN 'base_node_not_incident_to_rcsdroad' WHEN g.any_incident THEN 'base_mainnodeid_graph_incident' WHEN g.base_id IS NOT NULL THEN 'base_mainnodeid_not_incident_to_rcsdroad'
    ELSE 'base_id_not_found_in_rcsdnode_out' END AS state FROM relation_last r LEFT JOIN net_nodes n ON n.id = r.base_id LEFT JOIN i ON i.id = r.base_id LEFT JOIN g ON g.base_id = r.base_id""")
def _(v):
    from ..plans.anchor import graph_consumability
    return graph_consumability(relation_last(v), v.net_nodes, v.net_roads).select("target_id", "base_id", "state")


@query("attached_component_bridge", f"""WITH {components_sql('WHERE road_id % 3 <> 0')}, b AS (SELECT DISTINCT c.component, e.road_id AS segment_id FROM comp c JOIN chain_both e ON e.src = c.node WHERE e.road_id % 3 = 0)
    SELECT component, count(*) AS segments FROM b GROUP BY component HAVING count(*) >= 2""")
def _(v):
    from ..plans.replace import bridge_components
    edges = chain_edges(v)
    replaced = edges.where(F.col("road_id") % 3 == 0).withColumn("segment_id", F.col("road_id"))
    return bridge_components(edges.where(F.col("road_id") % 3 != 0), replaced)


@query("mainnode_flatten", """WITH a AS (SELECT id AS alias_id, CASE WHEN id % 8 = 1 THEN NULL ELSE id - 1 END AS t FROM net_nodes) SELECT alias_id, alias_id - (alias_id - 1) % 8 AS root_id,
    (alias_id - 1) % 8 AS hops FROM a WHERE t IS NOT NULL""")
def _(v):
    aliases = v.net_nodes.where(F.col("id") % 8 != 1).select(F.col("id").alias("alias_id"), (F.col("id") - 1).alias("target_id"))
    return GR.flatten_aliases(aliases).select("alias_id", "root_id", "hops")


@query("conflict_components", f"""WITH {components_sql()} SELECT component, arg_max(node, struct_pack(s := node * 37 % 101, n := -node)) AS winner, count(*) AS owners FROM comp GROUP BY component""")
def _(v):
    from ..plans.segment import resolve_conflicts
    members = chain_edges(v).select(F.col("road_id").alias("member"), F.explode(F.array("src", "dst")).alias("owner"))
    owners = members.select("owner").distinct().withColumn("score", F.col("owner") * 37 % 101)
    return resolve_conflicts(members, owners)


@query("minimum_spanning_links", """SELECT road_id FROM chain_edges e WHERE road_id < 10000000000 OR NOT EXISTS (SELECT 1 FROM chain_edges o WHERE o.unit = e.unit AND o.road_id < 10000000000)""")
def _(v):
    return GR.minimum_spanning_links(chain_edges(v))
