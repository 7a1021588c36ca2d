"""Steps whose work must not grow faster than the tables."""
import random

from pyspark.sql import functions as F

from waymesh.functions import geometry as G
from waymesh.operators import spatial as SP
from waymesh.plans import checks as C

LINE = "line_id long, pts array<struct<x:double,y:double>>"


def test_pieces_within_a_limit_are_those_whose_gap_is_at_most_that(spark):
    rng = random.Random(11)

    def lines(n):
        return [(i, [(float(rng.randrange(0, 60)), float(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 4))]) for i in range(n)]

    odd = [(60, None), (61, [(1.0, None), (2.0, 3.0)]), (62, [(40.0, 40.0), (None, None)]), (63, [(None, 1.0), (2.0, None)])]
    a, b = spark.createDataFrame(lines(60) + odd, LINE), spark.createDataFrame(lines(60), LINE)
    p = a.select("line_id", F.explode(G.pieces(F.col("pts"))).alias("p"))
    q = b.select(F.col("line_id").alias("other"), F.explode(G.pieces(F.col("pts"))).alias("q"))
    for limit in (0.0, 5.0, 13.0):
        wanted = {tuple(r) for r in p.join(q, G.piece_gap(F.col("p"), F.col("q")) <= limit).select("line_id", "other").distinct().collect()}
        (fp, cp), (fq, cq) = SP.flat_pieces(p, "p"), SP.flat_pieces(q, "q")
        got = {tuple(r) for r in fp.join(fq, G.pieces_within(cp, cq, limit)).select("line_id", "other").distinct().collect()}
        assert got == wanted and got
    found = {tuple(r) for r in C.segment_slice(a, b, 13.0).collect()}
    assert found == wanted


def edge_frame(spark, rows):
    return spark.createDataFrame(rows, "unit long, src long, dst long, road_id long, length_m double, level int")


def test_small_units_are_relaxed_without_rounds(spark, monkeypatch):
    from waymesh.operators import search as S
    rng = random.Random(5)
    rows = [(u, rng.randrange(7), rng.randrange(7), None if i % 5 == 4 else 100 * u + i, float(rng.randrange(1, 9)), rng.randrange(3)) for u in range(12) for i in range(12)]
    edges, pairs = edge_frame(spark, rows), spark.createDataFrame([(u, 0, 6) for u in range(14)] + [(20, 3, 3)], "unit long, a long, b long")
    slow = sorted(map(tuple, S._relaxation_in_rounds(edges, pairs, 3)[0].collect()), key=str)

    def no_rounds(*_):
        raise AssertionError("a unit of few edges went through rounds")

    with monkeypatch.context() as m:
        m.setattr(S, "shortest_distances", no_rounds)
        fast, ways = S.least_relaxation(edges, pairs, 3)
        assert sorted(map(tuple, fast.collect()), key=str) == slow and ways.count() > 10
    m = 200
    crowded = edges.unionAll(edge_frame(spark, [(m, i % 7, (i + 1) % 7, i, 1.0, i % 7 % 2) for i in range(70)]))
    both, _ = S.least_relaxation(crowded, pairs.unionAll(spark.createDataFrame([(m, 0, 6)], pairs.schema)), 3)
    assert both.where(f"unit = {m}").select("level", "length_m").collect() == [(1, 6.0)]
    assert sorted(map(tuple, both.where(f"unit != {m}").collect()), key=str) == slow


def test_small_components_are_staged_without_rounds(spark, monkeypatch):
    from waymesh.operators import graph as GR
    from waymesh.plans import segment as SG
    roads = [(1, 2, 10, 1), (2, 3, 11, 1), (3, 4, 12, 1), (1, 3, 13, 9), (101, 102, 20, 2), (102, 103, 21, 2), (201, 202, 21, 1), (202, 203, 30, 1)]
    edges = GR.both_ways(spark.createDataFrame(roads, "src long, dst long, road_id long, length_m long"))

    def nodes(*ids):
        return spark.createDataFrame([(i,) for i in ids], "node long")

    stages = [("4", nodes(1, 4, 101, 103), nodes(2, 3, 102)), ("5A", nodes(1, 3, 202, 203, 999), nodes(2))]
    want = [(10, "1-4", "4"), (11, "1-4", "4"), (12, "1-4", "4"), (13, "1-3", "5A"), (20, "101-103", "4"), (21, "101-103", "4"), (30, "202-203", "5A")]

    def no_rounds(*_):
        raise AssertionError("a component of few edges went through rounds")

    with monkeypatch.context() as m:
        m.setattr(SG, "through_pairs", no_rounds)
        assert sorted(map(tuple, SG.staged_rounds(edges, stages).collect())) == want
    monkeypatch.setattr(SG, "MOST_IN_ROW", 6)  # the first component goes through rounds now
    assert sorted(map(tuple, SG.staged_rounds(edges.where("road_id < 20 OR road_id = 30"), stages).collect())) == want[:4] + want[-1:]


def test_straightest_in_a_crowded_sector_goes_through_no_frame_anew(spark):
    from waymesh.operators.angles import straightest
    rng = random.Random(6)
    heads = [(1, i, rng.randrange(3600) / 10) for i in range(40)] + [(2, i, 5 + i % 90 / 10) for i in range(120)]
    outs = [(1, i, rng.randrange(3600) / 10) for i in range(9)] + [(2, i, 5 + i % 70 / 7) for i in range(150)]
    made = straightest(spark.createDataFrame(heads, "junction_id long, in_id long, heading double"), spark.createDataFrame(outs, "junction_id long, out_id long, angle double"), ["junction_id"])
    got = {(r.junction_id, r.in_id): round(r.turn_deg, 6) for r in made.collect()}
    turn = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360)
    assert got == {(j, i): round(min(turn(h, a) for k, _, a in outs if k == j), 6) for j, i, h in heads}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, currentrow$(), unboundedfollowing$()" not in plan and "RangeFrame, unboundedpreceding$(), currentrow$()" in plan


def test_ancestors_are_joined_to_owners_not_to_links(spark):
    from waymesh.plans import lanes as L
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 9), (5, 1)], "from_lane long, to_lane long")
    owner = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 12), (5, 77)], "lane_id long, road_id long")
    pairs = spark.createDataFrame([(10, 11), (5, 6)], "from_road long, to_road long")
    lineage = spark.createDataFrame([(10, 5), (11, 5), (12, 6)], "road_id long, parent_id long")
    made = L.lane_links_on_roads(links, owner, pairs, lineage)
    assert {(r.from_lane, r.to_lane): r.state for r in made.collect()} == {
        (1, 2): "direct", (1, 3): "by_lineage", (2, 3): "by_lineage", (3, 4): "same_road", (4, 9): "lane_without_road", (5, 1): "unsupported"}
    joins = [x for x in made._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 5 + 1 and not any("(from_road#" in x and "to_road#" not in x for x in joins)
