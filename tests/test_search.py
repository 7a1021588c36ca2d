"""Searches for many units against brute force on random graphs with one-way roads and cycles."""
import heapq
import itertools
import random
from collections import defaultdict

import pytest

from waymesh.operators import search as S


def graph(rng, n, m, units=1, levels=1):
    rows = []
    for u in range(units):
        for i in range(m):
            a, b = rng.sample(range(n), 2)
            rows.append((u, a, b, 1000 * u + i, float(rng.randint(1, 9)), rng.randrange(levels)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "unit long, src long, dst long, road_id long, length_m double, level int")


def reached(rows, unit, start):
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        for u, s, d, *_ in rows:
            if u == unit and s == a and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_reach_of_many_sets(spark, monkeypatch):
    monkeypatch.setattr(S, "WORD_BITS", 3)
    rng = random.Random(1)
    rows = graph(rng, 10, 14, units=3)
    starts = [(u, f"arm{a}", rng.randrange(10)) for u in range(3) for a in range(8)] + [(0, "arm0", 9), (5, "lone", 4)]
    got = {(r.unit, r.arm, r.node) for r in S.reach_of_sets(frame(spark, rows), spark.createDataFrame(starts, "unit long, arm string, node long")).collect()}
    assert got == {(u, a, n) for u, a, s in starts for n in reached(rows, u, s)}


def test_reach_with_the_full_word(spark):
    rows = [(0, i, i + 1, i, 1.0, 0) for i in range(70)]
    starts = [(0, i, i) for i in range(70)]
    got = S.reach_of_sets(frame(spark, rows), spark.createDataFrame(starts, "unit long, arm long, node long"))
    assert {(r.arm, r.node) for r in got.collect()} == {(a, n) for a in range(70) for n in range(a, 71)}


def dijkstra(edges, start):
    best, heap = {}, [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        if a in best:
            continue
        best[a] = d
        for s, t, w in edges:
            if s == a and t not in best:
                heapq.heappush(heap, (d + w, t))
    return best


def test_least_relaxation(spark):
    rng = random.Random(2)
    rows = graph(rng, 9, 17, units=24, levels=3)
    pairs = [(u, 0, 8) for u in range(24)]
    outcome, ways = S.least_relaxation(frame(spark, rows), spark.createDataFrame(pairs, "unit long, a long, b long"), 3)
    want = {}
    for u, a, b in pairs:
        hits = [(lv, d[b]) for lv in range(3) if b in (d := dijkstra([(r[1], r[2], r[4]) for r in rows if r[0] == u and r[5] <= lv], a))]
        want[u] = hits[0] if hits else (None, None)
    assert {r.unit: (r.level, r.length_m) for r in outcome.collect()} == want and len({lv for lv, _ in want.values()}) == 4
    by_road, walked = {r[3]: r for r in rows}, defaultdict(list)
    for r in ways.collect():
        walked[r.unit].append((r.from_target, r.road_id))
    for u, steps in walked.items():
        roads = [by_road[r] for _, r in sorted(steps, reverse=True)]
        assert roads[0][1] == 0 and roads[-1][2] == 8 and all(x[2] == y[1] for x, y in zip(roads, roads[1:]))
        assert (max(r[5] for r in roads), sum(r[4] for r in roads)) == want[u]


def test_nearest_owners_equal_a_search_per_owner(spark):
    rng = random.Random(3)
    rows = graph(rng, 40, 60)
    both = [(a, b, w) for _, a, b, _, w, _ in rows] + [(b, a, w) for _, a, b, _, w, _ in rows]
    owners = [(rng.randrange(40), f"o{i % 5}") for i in range(7)]
    got = S.nearest_owners(spark.createDataFrame(both, "src long, dst long, length_m double"), spark.createDataFrame(owners, "node long, owner string"), 12.0)
    want = {}
    for start, owner in owners:
        for n, d in dijkstra(both, start).items():
            if d <= 12:
                want[n] = min(want.get(n, (99, "")), (d, owner))
    assert {r.node: (r.dist_m, r.owner) for r in got.collect()} == want


def components(nodes, arcs):
    rows = [(0, a, b) for a, b in arcs]
    reach = {n: reached(rows, 0, n) for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [4, 5])
def test_strong_components_and_longest_chains(spark, seed):
    rng = random.Random(seed)
    units = {u: (list(range(12)), list({tuple(rng.sample(range(12), 2)) for _ in range(rng.choice([8, 14, 18]))}), [rng.randint(1, 9) for _ in range(12)]) for u in range(3)}
    arcs = spark.createDataFrame([(u, a, b) for u, (_, e, _) in units.items() for a, b in e], "unit long, src long, dst long")
    pieces = spark.createDataFrame([(u, n, float(w)) for u, (_, _, ws) in units.items() for n, w in enumerate(ws)], "unit long, piece long, weight double")
    got = defaultdict(dict)
    for r in S.longest_chains(arcs, pieces).collect():
        got[r.unit][r.piece] = r.chain_no
    for u, (nodes, e, ws) in units.items():
        comp = components(nodes, e)
        weight = defaultdict(int)
        for n in nodes:
            weight[comp[n]] += ws[n]
        after = defaultdict(set)
        for a, b in e:
            if comp[a] != comp[b]:
                after[comp[a]].add(comp[b])
        paths, todo = [], [[c] for c in weight]
        while todo:
            p = todo.pop()
            paths.append(p)
            todo += [[*p, c] for c in after[p[-1]]]
        best = min(paths, key=lambda p: (-sum(weight[c] for c in p), p[::-1]))
        assert got[u] == {n: best.index(comp[n]) for n in nodes if comp[n] in best}, u


def all_paths(rows, unit, a, b, limit):
    out, todo = [], [(0.0, [], [a])]
    while todo:
        m, roads, nodes = todo.pop()
        if nodes[-1] == b:
            out.append((m, roads, nodes))
            continue
        for u, s, d, r, w, _ in rows:
            if u == unit and s == nodes[-1] and d not in nodes and m + w <= limit:
                todo.append((m + w, [*roads, r], [*nodes, d]))
    return sorted(out)


def test_best_paths_equal_enumeration(spark):
    rng = random.Random(6)
    rows = graph(rng, 7, 15, units=4)
    rows += [(u, a, b, r + 500, w, 0) for u, b, a, r, w, _ in rows if r % 3 == 0]  # some both ways
    ends = [(u, 0, 6) for u in range(4)]
    got = defaultdict(list)
    for r in S.best_paths(frame(spark, rows), spark.createDataFrame(ends, "unit long, a long, b long"), 3, 25.0).collect():
        got[r.unit].append((r.rank, r.m, r.roads, r.nodes))
    for u, a, b in ends:
        assert [p[1:] for p in sorted(got[u])] == [tuple(p) for p in all_paths(rows, u, a, b, 25.0)[:3]], u
        assert [p[0] for p in sorted(got[u])] == list(range(1, len(got[u]) + 1))


def test_paths_within_a_limit_are_marked(spark):
    rows = [(0, 1, 2, 10, 3.0, 0), (0, 2, 3, 11, 3.0, 0), (0, 3, 4, 12, 3.0, 0), (1, 1, 2, 20, 3.0, 0)]
    found, over = S.paths_within(frame(spark, rows), spark.createDataFrame([(0, 1), (1, 1)], "unit long, node long"), 7.0)
    assert sorted((r.unit, tuple(r.roads)) for r in found.collect()) == [(0, (10,)), (0, (10, 11)), (1, (20,))]
    assert [r.unit for r in over.collect()] == [0]


def test_searches_on_nothing(spark):
    none = frame(spark, [(0, 1, 2, 3, 1.0, 0)]).limit(0)
    assert S.reach_of_sets(none, spark.createDataFrame([(0, 1, 5)], "unit long, arm long, node long")).count() == 1
    assert S.longest_chains(none, spark.createDataFrame([(0, 1, 5.0)], "unit long, piece long, weight double")).count() == 1
    assert S.best_paths(none, spark.createDataFrame([(0, 1, 5)], "unit long, a long, b long"), 3, 9.0).count() == 0
    assert list(itertools.chain(S.nearest_owners(none.select("src", "dst", "length_m"), spark.createDataFrame([], "node long, owner long"), 1.0).collect())) == []
