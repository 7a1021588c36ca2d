"""Graphs of few edges, solved in a row's Python call: what searches by rounds find, for units and components that fit in a row."""
from __future__ import annotations


def ordered(value):
    """Key by which a null comes before all values, as in Spark's order."""
    return (value is not None, 0 if value is None else value)


def least_ways(out, source):
    """``node`` → ``(distance, order, road, previous node)`` of the shortest ways from ``source``; equal ones by fewest edges, then the least last road.

    ``out`` gives for each node a list of ``(dst, length, order, road)``.
    """
    best = {source: (0.0, None, None, None)}
    frontier = [source]
    while frontier:
        offers = {}
        for node in frontier:
            for dst, length, order, road in out.get(node, ()):
                offer = (best[node][0] + length, order, road, node)
                if dst not in offers or (*offer[:2], node) < (*offers[dst][:2], offers[dst][3]):
                    offers[dst] = offer
        frontier = [node for node, offer in offers.items() if node not in best or offer[0] < best[node][0]]
        best.update((node, offers[node]) for node in frontier)
    return best


def way_back(best, target):
    """Roads of the way to ``target``, the last one first."""
    roads = []
    while best[target][3] is not None:
        roads.append(best[target][2])
        target = best[target][3]
    return roads


def least_level(edges, a, b, levels):
    """Least level of edges with which ``b`` is reached from ``a``, the length of the shortest way at that level, and its roads from the end."""
    out = {}
    for e in edges or ():
        for layer in range(levels):
            out.setdefault((e.src, layer), []).append(((e.dst, max(layer, e.level)), float(e.length_m), (ordered(e.road_id), layer), e.road_id))
    best = least_ways(out, (a, 0))
    level = next((layer for layer in range(levels) if (b, layer) in best), None)
    if level is None:
        return None
    return level, best[b, level][0], [(road, hop) for hop, road in enumerate(way_back(best, (b, level)))]


def reached(out, starts, halted):
    """Nodes reached from ``starts``, whose own edges are always followed; those of ``halted`` nodes are not."""
    seen, frontier = set(starts), list(starts)
    while frontier:
        fresh = {e[0] for node in frontier for e in out.get(node, ())} - seen
        seen |= fresh
        frontier = [node for node in fresh if node not in halted]
    return seen


def demotable(edges, nodes):
    """Those of ``nodes`` with two roads that lead to two others: nothing branches off there."""
    roads, others = {}, {}
    for e in edges:
        for node, other in ((e.src, e.dst), (e.dst, e.src)):
            roads.setdefault(node, set()).add(e.road_id)
            others.setdefault(node, set()).add(other)
    return {n for n in nodes if len(roads.get(n, ())) == 2 and len(others[n]) == 2}


def staged_roads(edges, marks, adaptive):
    """``road_id, a, b, stage`` of one component: every stage takes the shortest ways between its pairs from what the earlier ones left.

    ``edges`` hold ``src, dst, road_id, length_m``; ``marks`` gives for a node and stage whether it is a seed, whether ways pass through it and whether
    it is protected; ``adaptive`` tells for each stage whether ends that branch no more are passed.
    """
    stages = len(adaptive)
    seeds, through, protected = ([{m.node for m in marks if m.stage == k and m[flag]} for k in range(stages)] for flag in ("seed", "through", "protected"))
    found, pool = [], set()
    for stage in range(stages):
        out = {}
        for e in edges:
            out.setdefault(e.src, []).append((e.dst, float(e.length_m), e.road_id, e.road_id))
        ends, passed = seeds[stage] | pool, through[stage] - pool
        if adaptive[stage]:
            demoted = demotable(edges, ends - protected[stage])
            passed, ends = (passed - ends - protected[stage]) | demoted, ends - demoted
        stops = ({e.src for e in edges} | {e.dst for e in edges}) - passed
        hits = {(s, n) for s in ends for n in reached(out, {s}, stops) if n != s and n in ends}
        passing = {node: ways for node, ways in out.items() if node not in stops}
        owner = {}
        for a, b in sorted(pair for pair in hits if pair[0] < pair[1] and pair[::-1] in hits):
            inside = reached(passing, {e[0] for e in out[a]}, ())
            unit = {node: ways for node, ways in passing.items() if node in inside}
            for road in way_back(least_ways({**unit, a: out[a]}, a), b):
                owner.setdefault(road, (a, b))
        found += [(road, a, b, stage) for road, (a, b) in owner.items()]
        pool |= {node for pair in owner.values() for node in pair}
        edges = [e for e in edges if e.road_id not in owner]
    return found
