"""What kept the work from growing with the input: each test would have failed before the change it names."""
import itertools
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waymesh.catalog import views
from waymesh.operators import assignment as AS
from waymesh.operators import cells as C
from waymesh.operators import graph as GR
from waymesh.operators import intervals as I
from waymesh.operators import search as SE
from waymesh.operators import spatial as SP
from waymesh.operators.assignment import best_matching, best_matchings
from waymesh.operators.lanematch import lane_samples
from waymesh.plans import assembly as A
from waymesh.plans import lanes as L


def test_roads_are_not_sent_to_the_driver(spark):
    """lines are estimated far too small, so a limit of 10 MB sent all of them."""
    plan = entry.queries()["road_split_generate"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_equal_distances_are_settled_as_in_sql(spark, tmp_path):
    """F8: two places of one road are equally near, the last digit of the C library's pow decides."""
    duckdb.sql("COPY (SELECT * REPLACE (113805::BIGINT AS o_orderkey, 12652::BIGINT AS o_custkey) FROM '/root/testdata/sf0.001/orders.parquet' LIMIT 1) "
               f"TO '{tmp_path}/orders.parquet'")
    duckdb.sql(f"COPY (FROM '/root/testdata/sf0.001/customer.parquet') TO '{tmp_path}/customer.parquet'")
    rows = entry.queries()["project_point_on_line"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    assert [tuple(r) for r in rows] == con.execute(entry.oracle_sql()["project_point_on_line"]).fetchall() == [(113806, 15.6205, 31.241)]


def test_roads_with_few_claims_are_not_swept(spark, monkeypatch):
    """one shuffle cuts ordinary roads; the sweep of crowded roads gives the same."""
    claims = spark.createDataFrame([(r, (7 * i * r) % 50 - 3, (7 * i * r) % 50 + 1 + i % 9, i % 3, i % 4, i % 2) for r in range(1, 6) for i in range(12)],
                                   "road_id long, low long, high long, score int, segment_id long, member_id long")
    roads = spark.createDataFrame([(r, 10 * r) for r in range(7)], "road_id long, length_mm long")
    monkeypatch.setattr(I, "MOST_IN_ROW", 0)
    swept = sorted(map(tuple, A.target_fragments(claims, roads, 1).collect()))
    spans = sorted(map(str, I.fragments(claims.withColumn("rank", F.struct("score", "segment_id")), roads).collect()))
    held = sorted(map(tuple, I.covered_length(claims, ["road_id", "segment_id"]).collect()))
    monkeypatch.setattr(I, "MOST_IN_ROW", 64)
    monkeypatch.setattr(I, "swept_fragments", None)
    assert sorted(map(tuple, A.target_fragments(claims, roads, 1).collect())) == swept and swept
    assert sorted(map(str, I.fragments(claims.withColumn("rank", F.struct("score", "segment_id")), roads).collect())) == spans
    assert sorted(map(tuple, I.covered_length(claims, ["road_id", "segment_id"]).collect())) == held


def test_cells_of_a_column_are_one_run(spark, monkeypatch):
    """the rounds see runs; a block of 3 by 20 cells and one apart have two links between three runs."""
    seen = []

    def counted(links):
        seen.append(links.count())
        return GR.unit_components(links)

    monkeypatch.setattr(C, "unit_components", counted)
    block = [(1, x, y) for x in range(3) for y in range(20)] + [(1, 9, 9), (2, 0, 0), (2, 0, 2), (2, 1, 1), (2, 1, 2)]
    got = {tuple(r)[:3]: tuple(r["component"]) for r in C._components(spark.createDataFrame(block, "unit long, cx long, cy long")).collect()}
    assert seen == [3] and len(got) == len(block)
    assert {got[c] for c in block[:60]} == {(0, 0)} and got[(1, 9, 9)] == (9, 9) and got[(2, 0, 0)] == (0, 0)
    assert got[(2, 1, 1)] == got[(2, 0, 2)] == (0, 2)


def test_loops_do_not_lengthen_the_rounds(spark, monkeypatch):
    """a loop of 600 places beside chains of at most nine took as many rounds as the table is long."""
    cuts = []
    real = GR.cut
    monkeypatch.setattr(GR, "cut", lambda df: cuts.append(1) or real(df))
    steps = [(i, i + 1, 1.0) for i in range(9)] + [(100, 5, 2.0)] + [(1000 + i, 1000 + (i + 1) % 600, 1.0) for i in range(600)] + [(50, 1000, 1.0)]
    got = {r.place: r for r in GR.follow_chain(spark.createDataFrame(steps, "place long, next_place long, step_m double")).collect()}
    assert len(cuts) <= 7 and len(got) == len(steps)
    assert all((got[i].end_place, got[i].dist_m, got[i].hops, got[i].closed) == (9, 9.0 - i, 9 - i, False) for i in range(9))
    assert (got[100].end_place, got[100].dist_m, got[100].hops) == (9, 6.0, 5)
    assert got[50].closed and all(got[1000 + i].closed for i in range(600))


def test_chains_of_small_units_are_solved_in_their_row(spark, monkeypatch):
    """units of few pieces take no rounds; the rounds of large units give the same."""
    pieces = [(u, p, 1 + (u * p) % 5) for u in range(12) for p in range(7)]
    arcs = [(u, a, b) for u in range(12) for a, b in itertools.permutations(range(7), 2) if (u * 31 + a * 17 + b * 5) % 6 == 0]
    pieces, arcs = spark.createDataFrame(pieces, "unit long, piece long, weight long"), spark.createDataFrame(arcs, "unit long, src long, dst long")
    rounds = sorted(map(tuple, SE._chains_in_rounds(arcs, pieces).collect()))
    monkeypatch.setattr(SE, "_chains_in_rounds", None)
    assert sorted(map(tuple, SE.longest_chains(arcs, pieces).collect())) == rounds and rounds


def test_either_side_of_a_cell_join_is_shuffled_once(spark):
    """cell sizes do not shuffle both sides a second time, and what meets in a cell is grouped there."""
    points = spark.range(400).selectExpr("id AS p_id", "CAST(id % 20 AS DOUBLE) AS x", "CAST(id / 20 AS DOUBLE) AS y")
    lines = spark.range(60).selectExpr("id AS line_id", "array(struct(CAST(id % 8 AS DOUBLE) AS x, 0D AS y), struct(CAST(id % 8 AS DOUBLE) AS x, 9D AS y), struct(9D AS x, 9D AS y)) AS pts")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        near = SP.points_near_lines(points, lines, 3.0)
        plan = near._jdf.queryExecution().executedPlan().toString()
        rows = near.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert plan.count("Exchange hashpartitioning(cx") <= 4  # the sizes, for each use, and either side once
    assert "hashpartitioning(p_id" not in plan
    places = {r.p_id: (r.x, r.y) for r in points.collect()}
    lengths = {}
    for (p, (x, y)), line in itertools.product(places.items(), range(60)):
        at = line % 8
        d = min(math.hypot(x - at, max(0, y - 9, -y)), math.hypot(max(at - x, x - 9, 0), y - 9))
        if d <= 3.0:
            lengths[p, line] = round(d, 9)
    assert {(r.p_id, r.line_id): round(r.dist, 9) for r in rows} == lengths and len(rows) == len(lengths)


def test_samples_of_a_lane_are_shuffled_by_lane_only(spark):
    """candidates of samples and samples of lanes need one shuffle, and roads bring their ends along."""
    lanes = spark.sql("SELECT id AS lane_id, array(struct(0D AS x, CAST(id AS DOUBLE) AS y), struct(90D AS x, CAST(id AS DOUBLE) AS y)) AS pts FROM range(5)")
    roads = spark.sql("SELECT id AS line_id, 2 AS direction, array(id, id + 1) AS ends, array(struct(30D * id AS x, 0D AS y), struct(30D * id + 30 AS x, 0D AS y)) AS pts FROM range(3)")
    found = L.map_match(lane_samples(lanes, 10.0), roads, 25.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # the cell join and the crowded cells of either side
    assert [r.road_id for r in found.where("lane_id = 3").orderBy("i").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_arms_of_many_junctions_are_matched_in_one_call(spark):
    """one call a junction cost milliseconds each; the same steps are taken for thousands at once."""
    rng = np.random.default_rng(3)
    gains = []
    for k in range(300):
        shape = rng.integers(1, 9, 2)
        gain = np.where(rng.random(shape) < 0.7, rng.integers(40, 60, shape) * 0.5, -np.inf)
        gain = gain[np.isfinite(gain).any(axis=1)]
        gains.append(gain[:, np.isfinite(gain).any(axis=0)])
    padded = np.full((300, 9, 9), -np.inf)
    for k, gain in enumerate(gains):
        padded[k, :gain.shape[0], :gain.shape[1]] = gain
    got = best_matchings(padded)
    for k, gain in enumerate(gains):
        assert sorted(best_matching(gain)) == [(i, int(j)) for i, j in enumerate(got[k]) if j >= 0]


def test_shuffles_are_cut_finer_with_size(spark, monkeypatch):
    """The bytes of one task stay the same when tables grow, and only tables that a query reads count."""
    monkeypatch.setattr(views, "ROWS_A_TASK", 1_000)
    entry.queries()["road_lane_relation"](spark, "/root/testdata/sf0.01")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(16 << 20)
    assert spark.conf.get(views.INITIAL_PARTS) == "60"
    views.Views(spark, "/root/testdata/sf0.01").part
    assert spark.conf.get(views.INITIAL_PARTS) == "4"


def test_dealt_rows_get_more_tasks_with_size(spark, monkeypatch):
    """rows were dealt over the cores only, however many there are."""
    monkeypatch.setattr(views, "SPREAD_ROWS", 100)
    v = views.Views(spark, "/root/testdata/sf0.01")
    assert v.spread(v.net_roads).rdd.getNumPartitions() == 150


def test_small_units_are_solved_in_their_row(spark, monkeypatch):
    """Every road of the main network is a unit of its own, and all of them went through the rounds."""
    links = [(u, (7 * i * u) % 20, (7 * i * u + 3 * u) % 20) for u in range(1, 9) for i in range(8)] + [(9, 4, 4), (10, None, 2), (10, 2, 3), (11, 1, 2), (11, 3, 4)]
    frame = spark.createDataFrame(links, "unit long, src long, dst long")
    monkeypatch.setattr(GR, "MOST_IN_ROW", 0)
    rounds = set(map(tuple, GR.unit_components(frame).collect()))
    monkeypatch.setattr(GR, "MOST_IN_ROW", 8)
    crowded = frame.unionAll(spark.createDataFrame([(12, i, i + 1) for i in range(9)], frame.schema))
    assert set(map(tuple, GR.unit_components(crowded).collect())) == rounds | {(12, i, 0) for i in range(10)}
    monkeypatch.setattr(GR, "connected_components", None)
    rows = list(map(tuple, GR.unit_components(frame).collect()))
    assert set(rows) == rounds and len(rows) == len(rounds)


def test_rounds_on_few_pairs_have_few_tasks(spark, monkeypatch):
    """pipeline, op4: every shuffle of a round on a few thousand pairs had as many tasks and files as one on millions."""
    parts, real = [], GR.cut
    monkeypatch.setattr(GR, "cut", lambda df: parts.append(real(df)) or parts[-1])
    monkeypatch.setattr(GR, "PAIRS_A_TASK", 50)
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
        assert {tuple(r) for r in GR.connected_components(chain).collect()} == {(i, 0) for i in range(101)}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(p.rdd.getNumPartitions() <= 4 for p in parts[1:]) and len(parts) > 2


def test_small_units_are_assigned_in_their_row(spark, monkeypatch):
    """units of a few pairs went through rounds of joins, every one of which shuffled all pairs."""
    pairs = [(u, (5 * i * u) % 7, (3 * i + u) % 5, float((i * u * 13) % 9)) for u in range(1, 9) for i in range(12)] + [(9, None, 1, 2.0), (9, None, 2, 1.0), (9, 3, 2, 0.5)]
    frame = spark.createDataFrame(pairs, "unit long, left long, right long, score double").groupBy("unit", "left", "right").agg(F.max("score").alias("score"))
    monkeypatch.setattr(AS, "MOST_IN_ROW", 0)
    rounds = sorted(map(str, AS.greedy_assignment(frame).collect()))
    monkeypatch.setattr(AS, "MOST_IN_ROW", 5)
    assert sorted(map(str, AS.greedy_assignment(frame).collect())) == rounds and len(rounds) > 20
    monkeypatch.setattr(AS, "MOST_IN_ROW", 64)
    monkeypatch.setattr(AS, "greedy_select", None)
    assert sorted(map(str, AS.greedy_assignment(frame).collect())) == rounds
