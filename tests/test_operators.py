"""Hand-made tables and brute force for operators; order of input must not matter."""
import random

from pyspark.sql import functions as F

from waymesh.functions import geometry as G
from waymesh.operators import graph as GR
from waymesh.operators import spatial as SP
from waymesh.operators.aggregates import cardinality_errors, in_out_degree
from waymesh.operators.assignment import exclusive_assignment, greedy_assignment
from waymesh.operators.ordered import sessionize, with_running_sum
from waymesh.operators.quantiles import exact_quantiles
from waymesh.plans.preprocess import lane_groups


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, road_id long, length_m double")


def test_components_match_union_find(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), i, 1.0) for i in range(45)]
    parent = {n: n for r in rows for n in r[:2]}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b, *_ in rows:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in GR.connected_components(edges(spark, rows)).collect()}
    assert got == {n: find(n) for n in parent}


def test_components_with_hubs_that_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(GR, "LEAST_HUB", 4)
    rows = [(500, n, n, 1.0) for n in range(100, 180)] + [(n, n + 1, n, 1.0) for n in range(180, 240)] + [(500, 3, 1, 1.0), (7, 8, 2, 1.0)]
    got = {r.node: r.component for r in GR.connected_components(edges(spark, rows)).collect()}
    assert got == {500: 3, 3: 3, 7: 7, 8: 7} | {n: 3 for n in range(100, 180)} | {n: 180 for n in range(180, 241)}
    assert GR.connected_components(edges(spark, rows).limit(0)).count() == 0


def test_bridges_on_cycle_with_tail(spark):
    rows = [(1, 2, 10, 1.0), (2, 3, 11, 1.0), (3, 1, 12, 1.0), (3, 4, 13, 1.0), (4, 5, 14, 1.0)]
    assert {r.road_id for r in GR.bridge_edges(edges(spark, rows)).collect()} == {13, 14}


def test_follow_chain_marks_loops(spark):
    steps = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (7, 8, 1.0), (8, 7, 1.0)], "place long, next_place long, step_m double")
    got = {r.place: (r.end_place, r.dist_m, r.closed) for r in GR.follow_chain(steps).collect()}
    assert got[1] == (3, 3.0, False) and got[2] == (3, 2.0, False) and got[7][2] and got[8][2]


def test_topo_offsets_flags_cycle(spark):
    rows = [(1, 2, 1, 5.0), (1, 3, 2, 1.0), (3, 2, 3, 1.0), (8, 9, 4, 1.0), (9, 8, 5, 1.0)]
    got = {r.node: (r.offset_m, r.on_cycle) for r in GR.topo_offsets(edges(spark, rows)).collect()}
    assert got[2] == (2.0, False) and got[8][1] and got[9][1]


def test_grid_join_equals_brute_force_with_crowded_cells(spark):
    rng = random.Random(5)
    left = [(i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(60)]
    right = [(i, 10.0, 10.0) if i % 3 == 0 else (i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(90)]
    a = spark.createDataFrame(left, "l_id long, lx double, ly double")
    b = spark.createDataFrame(right, "r_id long, rx double, ry double")
    got = {(r.l_id, r.r_id) for r in SP.distance_join(a, b, 7.0).collect()}
    assert got == {(i, j) for i, x, y in left for j, p, q in right if (x - p) ** 2 + (y - q) ** 2 <= 49}
    cells = SP.with_cell(b, "rx", "ry", 10.0)
    salted = SP.salted_cell_join(SP.with_cell(a, "lx", "ly", 10.0), cells, "r_id", hot_rows=5)
    plain = SP.with_cell(a, "lx", "ly", 10.0).join(cells, ["cx", "cy"])
    assert sorted((r.l_id, r.r_id) for r in salted.collect()) == sorted((r.l_id, r.r_id) for r in plain.collect())


def test_sessionize_across_chunks(spark):
    rows = [("a", t, i) for i, t in enumerate([0, 1, 2, 30, 31, 95, 96, 97])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, i long")
    parts = sessionize(df, "k", ["t", "i"], F.col("t") - F.col("prev_t") > 10, ["t"], 25.0)
    assert [r.part_no for r in parts.orderBy("t").collect()] == [0, 0, 0, 1, 1, 2, 2, 2]
    total = with_running_sum(df, "k", ["t", "i"], F.lit(1), "n", 25.0)
    assert [r.n for r in total.orderBy("t").collect()] == list(range(1, 9))


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10)], "k string, v double")
    row = exact_quantiles(df, "k", "v", {"p50": 0.5, "p90": 0.9}, 2.0).first()
    assert row.p50 == 3.0 and abs(row.p90 - 7.6) < 1e-9


def test_exclusive_assignment_prefers_more_matches_then_score(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 10.0), (1, 1, 2, 9.0), (1, 2, 1, 9.0)], "unit long, left long, right long, score double")
    assert {(r.left, r.right) for r in exclusive_assignment(pairs).collect()} == {(1, 2), (2, 1)}
    assert {(r.left, r.right) for r in greedy_assignment(pairs).collect()} == {(1, 1)}


def test_degree_counts_inner_roads_both_ways(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 0), (2, 1, 3)], "src long, dst long, direction int")
    got = {r.junction_id: (r.in_degree, r.out_degree) for r in in_out_degree(df).collect()}
    assert got == {1: (2, 3), 2: (2, 1)}


def test_cardinality_errors(spark):
    df = spark.createDataFrame([(1, 10, 0), (1, 11, 0), (2, 10, 0), (3, 12, 1)], "target_id long, base_id long, status int")
    got = {(r.error_type, r.target_id, r.base_id) for r in cardinality_errors(df).collect()}
    assert got == {("one_target_to_many_base", 1, 10), ("one_target_to_many_base", 1, 11), ("many_target_to_one_base", 1, 10),
                   ("many_target_to_one_base", 2, 10), ("duplicate_target_rows", 1, None)}


def test_lane_groups_follow_sequence(spark):
    lanes = spark.createDataFrame([(100, 2, "L,R", 2), (100, 1, "S", 2), (101, 1, "", 2), (999, 1, "S", 2)], "link long, seq int, arrow string, lane_dir int")
    roads = spark.createDataFrame([(100, 2, [(0.0, 0.0), (1.0, 0.0)])], "id long, direction int, pts array<struct<x:double,y:double>>")
    rows = lane_groups(lanes, roads).collect()
    assert [(r.link, r.arrows, r.sequence_complete) for r in rows] == [(100, "S,L,R", True)]


def test_line_cuts_merge_and_drop(spark):
    df = spark.range(1).select(G.normalized_cuts(F.array(*[F.lit(x) for x in (0.5, 4.0, 5.0, 9.8)]), F.lit(10.0), 2.0, 1.0).alias("c"))
    assert df.first().c == [4.5]


def test_assignment_is_exact_at_every_size(spark):
    from waymesh.operators.assignment import best_matching, exclusive_assignment
    import itertools

    import numpy as np
    rng = np.random.default_rng(3)
    for rows, columns in ((1, 1), (3, 5), (6, 4), (6, 6)):
        gain = rng.integers(1, 50, (rows, columns)).astype(float)
        wide = np.concatenate((gain, np.zeros((rows, rows))), axis=1)
        want = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(columns + rows), rows)) if rows < 5 else None
        got = best_matching(gain)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert want is None or sum(gain[p] for p in got) == want
    table = [(1, i, j, float(10 if i == j else 9 - (i - j) % 4)) for i in range(4) for j in range(4)]
    found = exclusive_assignment(spark.createDataFrame(table, "unit long, left long, right long, score double")).collect()
    assert sum(r["score"] for r in found) == 40.0 and len(found) == 4


def test_alias_rings_take_their_smallest_member(spark):
    from waymesh.operators.graph import flatten_aliases
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (9, 8)], "alias_id long, target_id long")
    assert {r["alias_id"]: r["root_id"] for r in flatten_aliases(rows).collect()} == {1: 1, 2: 1, 3: 1, 9: 8}


def test_spanning_links_of_nothing(spark):
    from waymesh.operators.graph import minimum_spanning_links
    loops = spark.createDataFrame([(1, 1, 7, 2.0)], "src long, dst long, road_id long, length_m double")
    assert minimum_spanning_links(loops).columns == ["road_id"] and minimum_spanning_links(loops).count() == 0


def test_full_rank_is_a_row_number(spark):
    from waymesh.operators.topk import full_rank
    rows = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 9, 3), (2, 1, 4)], "b int, v int, i int")
    assert {r["i"]: r["rank_no"] for r in full_rank(rows, "b", "v", "i").collect()} == {3: 1, 1: 2, 2: 3, 4: 1}
