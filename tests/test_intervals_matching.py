"""Interval sweeps and stable matching against plain sweeps and the definition of stability."""
import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from waymesh.operators import intervals as I
from waymesh.operators.matching import stable_matching


def test_dyadic_cells_are_the_interval(spark):
    rng = random.Random(1)
    rows = [(i, a := rng.randrange(5000), a + rng.randrange(0, 900)) for i in range(200)] + [(900, 0, 1 << 39), (901, 7, 8)]
    df = spark.createDataFrame(rows, "i long, low long, high long")
    got = {r.i: r.c for r in df.select("i", I.dyadic_cells(F.col("low"), F.col("high")).alias("c")).collect()}
    for i, low, high in rows:
        parts = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in got[i])
        assert [x for p in parts for x in p] == ([low] + [x for _, e in parts[:-1] for x in (e, e)] + [high] if low < high else [])
        assert all(n <= 2 for n in defaultdict(int, {lv: sum(c.level == lv for c in got[i]) for lv in range(41)}).values())


def plain(intervals, length):
    cuts = sorted({0, length} | {min(max(x, 0), length) for a, b, _ in intervals for x in (a, b) if max(a, 0) < min(b, length)})
    out = []
    for a, b in itertools.pairwise(cuts):
        best = min((r for x, y, r in intervals if x <= a and b <= y), default=None)
        if out and out[-1][2] == best:
            out[-1] = (out[-1][0], b, best)
        else:
            out.append((a, b, best))
    return out


def test_fragments_equal_a_plain_sweep(spark, monkeypatch):
    monkeypatch.setattr(I, "CHUNK_MM", 700.0)
    rng = random.Random(2)
    roads = [(r, rng.choice([0, 1000, 4000])) for r in range(25)] + [(99, 5000)]
    rows = [(r, a := rng.randrange(-300, 4000), a + rng.randrange(0, 1500), (rng.randrange(3), f"l{rng.randrange(4)}")) for r, _ in roads[:-1] for _ in range(rng.randrange(9))]
    got = defaultdict(list)
    df = I.fragments(spark.createDataFrame(rows, "road_id long, low long, high long, rank struct<p:int,label:string>"), spark.createDataFrame(roads, "road_id long, length_mm long"))
    for r in df.collect():
        got[r.road_id].append((r.low, r.high, tuple(r.best) if r.best else None))
    for road, length in roads:
        assert sorted(got[road]) == (plain([(a, b, k) for r, a, b, k in rows if r == road], length) if length else []), road


def test_one_road_that_all_intervals_cover(spark):
    n = 3000
    rows = [(1, i, 2 * n - i, (n - i, "x")) for i in range(n)]
    got = I.fragments(spark.createDataFrame(rows, "road_id long, low long, high long, rank struct<p:int,label:string>"), spark.createDataFrame([(1, 2 * n)], "road_id long, length_mm long"))
    assert sorted((r.low, r.high, r.best.p) for r in got.collect()) == sorted([(i, i + 1, n - i) for i in range(n - 1)] + [(2 * n - i - 1, 2 * n - i, n - i) for i in range(n - 1)] + [(n - 1, n + 1, 1)])


def test_covered_length(spark):
    rows = [(1, "f", 0, 10), (1, "f", 5, 20), (1, "f", 40, 50), (1, "r", 3, 3), (2, "f", 7, 9)]
    got = I.covered_length(spark.createDataFrame(rows, "unit long, way string, low long, high long"), ["unit", "way"])
    assert sorted((r.unit, r.way, r.covered_mm, r.low, r.high) for r in got.collect()) == [(1, "f", 30, 0, 50), (2, "f", 2, 7, 9)]


def test_matching_has_no_blocking_pair(spark):
    rng = random.Random(3)
    for _ in range(4):
        pairs = [(o, p, rng.randrange(4), rng.randrange(4)) for o in range(14) for p in range(11) if rng.random() < 0.5]
        got = stable_matching(spark.createDataFrame(pairs, "owner long, place long, wish int, worth int")).collect()
        assert len(got) == len(pairs)
        bound = {r.owner: r.place for r in got if r.state == "bound"}
        assert len(set(bound.values())) == len(bound)
        wish, worth = {(o, p): (w, p) for o, p, w, _ in pairs}, {(p, o): (w, o) for o, p, _, w in pairs}
        holder = {p: o for o, p in bound.items()}
        for o, p, *_ in pairs:
            assert (o in bound and wish[o, bound[o]] <= wish[o, p]) or (p in holder and worth[p, holder[p]] <= worth[p, o]), (o, p)
        # owners get the best place of any stable matching: by asking one after the other
        held, todo, asked = {}, sorted({o for o, *_ in pairs}), set()
        while todo:
            o = todo.pop()
            for w, p in sorted(wish[o, p] for q, p, *_ in pairs if q == o):
                if (o, p) in asked:
                    continue
                asked.add((o, p))
                if p not in held or worth[p, o] < worth[p, held[p]]:
                    if p in held:
                        todo.append(held[p])
                    held[p] = o
                    break
        assert {o: p for p, o in held.items()} == bound
        assert {(r.owner, r.place) for r in got if r.state == "demoted"} == asked - set(bound.items())


def test_matching_of_nothing(spark):
    assert stable_matching(spark.createDataFrame([], "owner long, place long, wish int, worth int")).count() == 0
