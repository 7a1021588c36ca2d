"""Queries and steps do all that the method they are named after does."""
from pyspark.sql import functions as F


class Tables:
    """Given tables in place of the views of a folder."""

    def __init__(self, **tables):
        self.__dict__.update(tables)

    @staticmethod
    def spread(df):
        return df


def test_corridor_reaches_fifty_metres(spark):
    from waymesh.catalog.registry import _QUERIES

    def roads(*rows):
        return spark.createDataFrame([(i, [(0.0, y), (100.0, y)]) for i, y in rows], "id long, pts array<struct<x:double,y:double>>")

    v = Tables(net_roads=roads((1, 0.0)), link_roads=roads((2, 10.0), (4, 49.0), (6, 51.0), (8, -30.0)))
    assert sorted(map(tuple, _QUERIES["corridor_candidates"](v).collect())) == [(1, 2, 1.0), (1, 4, 1.0), (1, 8, 1.0)]


def test_lane_links_run_over_junction_carriers(spark):
    from waymesh.plans import lanes as L

    def frame(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} long" for c in columns.split()))

    links = frame("from_lane to_lane", (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 1), (1, 7), (8, 6))
    owner = frame("lane_id road_id", (1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (6, 60), (8, 99), (8, 10))
    # 90 to 93 lie on junctions, 80 does not; 50 is five steps away
    pairs = frame("from_road to_road", (10, 90), (90, 20), (90, 91), (91, 30), (91, 92), (92, 40), (92, 93), (93, 50), (10, 80), (80, 60))
    made = L.lane_links_on_roads(links, owner, pairs, frame("road_id parent_id"), frame("road_id", (90,), (91,), (92,), (93,)))
    over, no = "via_junction_carrier", "unsupported"
    assert sorted(map(tuple, made.collect())) == [(1, 2, over), (1, 3, over), (1, 4, over), (1, 5, no), (1, 6, no), (1, 7, "lane_without_road"), (2, 1, no), (8, 6, no)]


def test_logical_groups_of_several_arms(spark):
    from waymesh.plans import arms as AR
    profiles = spark.createDataFrame([(j, d, a) for j in (1, 2, 3, 4, 5) for d in (0, 1) for a in (0, 1)] + [(6, 0, 0)], "junction_id long, dataset int, arm int")
    rows = [(1, 0, 0, 95.0, 80.0, False), (1, 0, 1, 80.0, 65.0, False),  # both stand for arm 0; arm 1 has nothing
            (2, 0, 0, 95.0, 80.0, False), (2, 1, 0, 70.0, 60.0, True),  # arm 1 gets no share and keeps arm 0
            (3, 0, 0, 90.0, 50.0, False), (3, 0, 1, 75.0, 60.0, False), (3, 1, 1, 95.0, 80.0, False), (3, 1, 0, 76.0, 60.0, False),  # each has its own
            (4, 0, 0, 59.0, 50.0, False), (4, 0, 1, 58.0, 50.0, False), (4, 1, 0, 39.0, 30.0, False),  # low, and rejected
            (5, 0, 0, 95.0, 80.0, False), (5, 0, 1, 74.9, 60.0, False), (5, 1, 1, 66.0, 60.0, True)]  # 20.1 below the best one
    made = AR.logical_groups(profiles, spark.createDataFrame(rows, "junction_id long, left_arm int, right_arm int, score double, non_geometry double, partial boolean"))
    got = {(r.junction_id, r.left_arm): tuple(r)[2:] for r in made.collect()}
    gone = (None, "missing", "none", "missing")
    assert got == {(1, 0): ([0, 1], "one_to_many", "over_split", "high"), (1, 1): gone,
                   (2, 0): ([0], "many_to_one", "over_merged", "high"), (2, 1): ([0], "many_to_one", "partial", "medium"),
                   (3, 0): ([0], "one_to_one", "full", "medium"), (3, 1): ([1], "one_to_one", "full", "high"),
                   (4, 0): ([0], "uncertain", "unknown", "low"), (4, 1): gone,
                   (5, 0): ([0], "one_to_one", "full", "high"), (5, 1): ([1], "one_to_one", "partial", "medium"), (6, 0): gone}


def test_stages_remember_ends_and_the_last_passes_those_that_branch_no_more(spark, monkeypatch):
    from waymesh.operators import graph as GR
    from waymesh.plans import segment as SG
    roads = [(1, 2, 11, 1), (2, 3, 12, 1), (3, 4, 13, 1), (4, 5, 14, 1), (5, 6, 15, 1), (21, 22, 31, 1), (22, 23, 32, 1), (22, 24, 33, 1)]
    edges = GR.both_ways(spark.createDataFrame(roads, "src long, dst long, road_id long, length_m long"))

    def nodes(*ids):
        return spark.createDataFrame([(i,) for i in ids], "node long")

    every = nodes(*{n for r in roads for n in r[:2]})
    others = lambda *ids: every.join(nodes(*ids), "node", "left_anti")
    stages = [("4", nodes(1, 2, 22, 24), others(1, 2, 22, 24)), ("5A", nodes(3, 21, 23), others(3, 21, 23))]
    start = [(11, "1-2", "4"), (12, "2-3", "5A"), (31, "21-22", "5A"), (32, "22-23", "5A"), (33, "22-24", "4")]
    free = [(13, "3-6", "5C"), (14, "3-6", "5C"), (15, "3-6", "5C")]  # 5 is a seed with two roads left
    held = [(13, "3-5", "5C"), (14, "3-5", "5C"), (15, "5-6", "5C")]
    for most, protected, want in ((64, (99,), free), (64, (5,), held), (0, (99,), free)):
        monkeypatch.setattr(SG, "MOST_IN_ROW", most)
        made = SG.staged_rounds(edges, [*stages, ("5C", nodes(5, 6), every, nodes(*protected))])
        assert sorted(map(tuple, made.collect())) == sorted(start + want)


def test_staged_residual_rounds_has_all_stages(spark, monkeypatch):
    from waymesh.catalog import segments
    from waymesh.catalog.registry import _QUERIES
    from waymesh.catalog.views import Views
    seen = []
    monkeypatch.setattr(segments.SG, "staged_rounds", lambda edges, stages: seen.extend(s[0] for s in stages))
    _QUERIES["staged_residual_rounds"](Views(spark, "/root/testdata/sf0.001"))
    assert seen == ["4", "5A", "5B", "5C"]


def test_portals_meet_all_nodes_and_are_not_grouped_by_pair(spark):
    import random

    from waymesh.plans import checks as C
    rng = random.Random(3)
    nodes = [(i, i - i % 3 if i % 4 else i, float(rng.randrange(300)), float(rng.randrange(300))) for i in range(1, 90)] + [(i, 200, 10.0, 10.0) for i in (200, 201)]
    members = [(n[1] if n[0] % 5 else n[1] + 1, n[0]) for n in nodes]  # some stand in a group that is not their own
    portals = [(i, rng.randrange(0, 90), role, float(rng.randrange(300)), float(rng.randrange(300))) for i in range(60) for role in ("source", "target")]
    edges = [(c, c + 1) for c in range(0, 90, 2)] + [(200, 5), (3, 200)]
    made = C.portal_candidates(spark.createDataFrame(portals, "portal_id long, junction_id long, role string, x double, y double"),
                               spark.createDataFrame(members, "junction_id long, node_id long"), spark.createDataFrame(nodes, "id long, canonical_id long, x double, y double"),
                               spark.createDataFrame(edges, "src long, dst long"), 50.0)
    usable = {("source", a) for a, _ in edges} | {("target", b) for _, b in edges}
    place = {n[0]: n[1:] for n in nodes}
    want = {}
    for portal, junction, role, x, y in portals:
        offers = [(i, 0) for j, i in members if j == junction] + [(i, 1) for i in place]
        for i, source in offers:
            c, nx, ny = place[i]
            gap = ((x - nx) * (x - nx) + (y - ny) * (y - ny)) ** 0.5
            if (role, c) in usable and (source == 0 or gap <= 50.0):
                want[portal, role, c] = min(want.get((portal, role, c), (gap, source, i)), (gap, source, i))
    got = {tuple(r)[:3]: (r.distance_m, 0 if r.source == "grouped_relation" else 1, r.raw_id) for r in made.collect()}
    assert got == want and len(want) > 300 and {w[1] for w in want.values()} == {0, 1}
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the pairs of ends and nodes around them go straight into the result
    side = plan[next(i for i, line in enumerate(plan) if "array_min" in line or "transform(raws" in line) - 1]
    assert "Aggregate" not in side and made.count() == len(want)


def test_lanes_of_a_cell_are_matched_side_by_side(spark, monkeypatch):
    import random

    from waymesh.operators import laneways as W
    from waymesh.operators.lanematch import lane_samples
    from waymesh.plans import lanes as L
    rng = random.Random(8)

    def line(n, x, y, step):
        return [(x + rng.randrange(-step, step + 1), y + rng.randrange(-step, step + 1)) for _ in range(n)]

    lanes = [(i, [(float(a), float(b)) for a, b in line(rng.randrange(2, 5), rng.randrange(900), rng.randrange(450), 40)]) for i in range(150)]
    lanes += [(200, [(0.0, 100.0), (900.0, 120.0)]), (201, [(5.0, None), (30.0, 40.0), (90.0, 90.0)]), (202, [(7.0, 7.0), (7.0, 7.0)]), (203, [(5000.0, 0.0), (5050.0, 0.0)])]
    roads = [(i, rng.choice([0, 1, 2, 3, None]), [rng.randrange(60), rng.choice([None, rng.randrange(60)])] if i % 20 else None,
              [(float(a), float(b)) for a, b in line(rng.randrange(2, 4), rng.randrange(900), rng.randrange(450), 30)]) for i in range(500)]
    roads += [(700 + i, 0, [1, 2], [(0.0, 50.0 + i % 2), (900.0, 50.0 + i % 2)]) for i in range(4)]  # equal ways
    pts = "array<struct<x:double,y:double>>"
    lanes = spark.createDataFrame(lanes, f"lane_id long, pts {pts}")
    roads = spark.createDataFrame(roads, f"line_id long, direction int, ends array<long>, pts {pts}")
    want = sorted(map(tuple, L.map_match(lane_samples(lanes, 10.0), roads, 25.0).collect()), key=str)
    assert sorted(map(tuple, L.match_lanes(lanes, roads, 10.0, 25.0).collect()), key=str) == want and len({r[2] for r in want}) > 100
    plan = L.match_lanes(lanes.where("lane_id < 150"), roads, 10.0, 25.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "collect_list" not in plan  # neither samples nor candidates are gathered by lane
    monkeypatch.setattr(W, "MOST_AT_ONCE", 1 << 9)
    monkeypatch.setattr(W, "MOST_ROADS", 3)
    table = lambda df: df.toArrow()
    one = table(lanes.where("lane_id < 150").selectExpr("lane_id", "pts.x AS xs", "pts.y AS ys").join(lane_samples(lanes, 1e9).select("lane_id", "lane_deg").distinct(), "lane_id"))
    from waymesh.functions import geometry as G
    heading = G.bearing(F.struct(F.col("p.x0").alias("x"), F.col("p.y0").alias("y")), F.struct(F.col("p.x1").alias("x"), F.col("p.y1").alias("y")))
    near = table(roads.select("line_id", "direction", "ends", F.explode(G.pieces(F.col("pts"))).alias("p")).select("line_id", "direction", "ends", "p.*", heading.alias("line_deg")))
    made = W.lane_ways(one, near, 10.0, 25.0, 50.0, 20.0, 3.0, 20.0)
    assert sorted(zip(*(made.column(c).to_pylist() for c in ("lane_id", "i", "road_id"))), key=str) == [r for r in want if r[0] < 150]


def test_corridors_of_a_cell_are_searched_side_by_side(spark, monkeypatch):
    import random

    from waymesh.operators import laneways as W
    from waymesh.operators import spatial as SP
    from waymesh.plans import replace as RP
    rng = random.Random(12)

    def line(n):
        x, y = rng.randrange(900), rng.randrange(500)
        return [(float(x + rng.randrange(-40, 41)), float(y + rng.randrange(-40, 41))) for _ in range(n)]

    pts = "array<struct<x:double,y:double>>"
    segments = [(i, line(rng.randrange(2, 5))) for i in range(80)] + [(90, [(0.0, 100.0), (900.0, 120.0)]), (91, [(5.0, None), (30.0, 40.0), (90.0, 90.0)]), (92, [(7.0, 7.0), (7.0, 7.0)]), (93, [(9e3, 9e3), (9e3, 9e3)])]
    carriers = [(i, line(rng.randrange(2, 4)), rng.choice([0, 128, 129]), rng.random() < 0.5) for i in range(150)] + [(200, [(0.0, 300.0), (900.0, 310.0)], 0, False), (201, [(8.0, None), (30.0, 40.0), (90.0, 90.0)], 0, False)]
    segments, carriers = spark.createDataFrame(segments, f"segment_id long, pts {pts}"), spark.createDataFrame(carriers, f"road_id long, pts {pts}, formway int, linked boolean")

    def found():
        return sorted(map(tuple, RP.corridor_candidates(segments, carriers, 50.0, 5.0).collect()))

    with monkeypatch.context() as m:
        m.setattr(SP, "HOME_EXTENT_M", -1.0)  # all segments go through the join of samples and pieces
        want = found()
    assert found() == want and {200, 201} <= {r[1] for r in want} and {90, 91, 92} <= {r[0] for r in want} and len(want) > 400
    plan = RP.corridor_candidates(segments.where("segment_id < 80"), carriers, 50.0, 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "point_piece" not in plan and "min(dist" not in plan
    import pyarrow as pa
    monkeypatch.setattr(W, "MOST_AT_ONCE", 4)
    some = [r for r in segments.where("segment_id < 80").collect()]
    cell = pa.table({"segment_id": [r.segment_id for r in some], "xs": [[p.x for p in r.pts] for r in some], "ys": [[p.y for p in r.pts] for r in some]})
    from waymesh.functions import geometry as G
    sampled = carriers.where("formway & 128 = 0 OR linked").select("road_id", G.length(F.col("pts")).alias("length_m"), F.size(G.sample(F.col("pts"), 5.0)).alias("samples"), F.inline(G.sample(F.col("pts"), 5.0))).toArrow()
    made = W.corridor_shares(cell, sampled, 50.0, 0.2, 1.0)
    assert sorted(zip(*(made.column(c).to_pylist() for c in ("segment_id", "road_id", "ratio")))) == [r for r in want if r[0] < 80]
