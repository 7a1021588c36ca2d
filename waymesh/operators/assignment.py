"""Exclusive assignment of left to right members inside each group."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import MOST_IN_ROW, greedy_select


def best_matching(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain, by shortest augmenting paths; -inf marks pairs that may not be used.

    Rows enter one by one. Each time the search for the cheapest way to a free column relaxes all columns at once.
    """
    rows, columns = gain.shape
    cost = np.where(np.isfinite(gain), -gain, 0.0)
    cost = np.concatenate((cost, np.zeros((rows, rows))), axis=1)  # every row may stay alone at no gain
    row_of = np.full(columns + rows, -1)
    row_price, column_price = np.zeros(rows), np.zeros(columns + rows)
    for start in range(rows):
        reach, came, done = np.full(columns + rows, np.inf), np.full(columns + rows, -1), np.zeros(columns + rows, bool)
        row, column, base = start, -1, 0.0
        while row >= 0:
            through = base + cost[row] - row_price[row] - column_price
            better = (through < reach) & ~done
            reach[better], came[better] = through[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            base, done[column], row = reach[column], True, row_of[column]
        closed = np.flatnonzero(done & (row_of >= 0))
        row_price[row_of[closed]] += base - reach[closed]
        row_price[start] += base
        column_price[done] += reach[done] - base
        while column >= 0:
            before = came[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    return [(int(row_of[c]), c) for c in range(columns) if row_of[c] >= 0 and np.isfinite(gain[row_of[c], c])]


def best_matchings(gain: np.ndarray) -> np.ndarray:
    """``best_matching`` of many matrices (unit, row, column) side by side: the same steps, taken by all units at once.

    Returns the column of every row, -1 for none. Rows and columns that are -inf throughout are padding and stay alone.
    """
    units, rows, columns = gain.shape
    wide = columns + rows
    cost = np.concatenate((np.where(np.isfinite(gain), -gain, 0.0), np.zeros((units, rows, rows))), axis=2)
    real_row, real_column = np.isfinite(gain).any(axis=2), np.isfinite(gain).any(axis=1)
    # a unit's own matrix ends with one spare column per real row; the other columns do not exist for it
    closed_off = ~np.concatenate((real_column, real_row), axis=1)
    cost = np.where(closed_off[:, None, :], np.inf, cost)
    row_of = np.full((units, wide), -1)
    row_price, column_price = np.zeros((units, rows)), np.zeros((units, wide))
    for start in range(rows):
        live = np.flatnonzero(real_row[:, start])
        reach, came, done = np.full((units, wide), np.inf), np.full((units, wide), -1), np.zeros((units, wide), bool)
        row, column, base = np.full(units, start), np.full(units, -1), np.zeros(units)
        at = live
        while len(at):
            through = base[at, None] + cost[at, row[at]] - row_price[at, row[at]][:, None] - column_price[at]
            better = (through < reach[at]) & ~done[at]
            reach[at] = np.where(better, through, reach[at])
            came[at] = np.where(better, column[at, None], came[at])
            column[at] = np.where(done[at], np.inf, reach[at]).argmin(axis=1)
            base[at] = reach[at, column[at]]
            done[at, column[at]] = True
            row[at] = row_of[at, column[at]]
            at = at[row[at] >= 0]
        u, c = np.nonzero(done & (row_of >= 0))
        row_price[u, row_of[u, c]] += base[u] - reach[u, c]
        row_price[live, start] += base[live]
        u, c = np.nonzero(done)
        column_price[u, c] += reach[u, c] - base[u]
        at = live
        while len(at):
            before = came[at, column[at]]
            row_of[at, column[at]] = np.where(before < 0, start, row_of[at, before])
            column[at] = before
            at = at[before >= 0]
    found = np.full((units, rows), -1)
    u, c = np.nonzero(row_of[:, :columns] >= 0)
    r = row_of[u, c]
    chosen = np.isfinite(gain[u, r, c])
    found[u[chosen], r[chosen]] = c[chosen]
    return found


MOST_CELLS = 1 << 22


def _solve(batches):
    for pdf in batches:
        sizes = pdf.pairs.map(len).to_numpy()
        # units of like size are solved together, in blocks of bounded memory
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            block = [pdf.pairs.iat[k] for k in order[at:at + 4096]]
            sides = [(np.unique([p["left"] for p in b]), np.unique([p["right"] for p in b])) for b in block]
            while len(block) > 1 and len(block) * max(len(l) for l, _ in sides) * (max(len(l) for l, _ in sides) + max(len(r) for _, r in sides)) > MOST_CELLS:
                block, sides = block[:len(block) // 2], sides[:len(block) // 2]
            gain = np.full((len(block), max(len(l) for l, _ in sides), max(len(r) for _, r in sides)), -np.inf)
            most = np.zeros(len(block))
            for k, (b, (lefts, rights)) in enumerate(zip(block, sides)):
                score = np.array([p["score"] for p in b], float)
                most[k] = np.abs(score).sum() + 1.0  # a further match outweighs any scores
                gain[k, np.searchsorted(lefts, [p["left"] for p in b]), np.searchsorted(rights, [p["right"] for p in b])] = score + most[k]
            matched = best_matchings(gain)
            out = []
            for k, (lefts, rights) in enumerate(sides):
                unit = pdf.unit.iat[order[at + k]]
                for i, j in enumerate(matched[k, :len(lefts)]):
                    if j >= 0:
                        out.append((unit, lefts[i], rights[j], gain[k, i, j] - most[k]))
            at += len(block)
            yield pd.DataFrame(out, columns=["unit", "left", "right", "score"]).round({"score": 9})


def exclusive_assignment(pairs: DataFrame) -> DataFrame:
    """Best one-to-one pairs per ``unit``: most matches, then the highest total, by one exact method at every size.

    ``pairs`` holds ``unit, left, right, score`` once each. Meant for units whose members are bounded, as the arms of a
    junction are by their sectors; for others use ``greedy_assignment``. A unit is one row and many are solved in one call.
    """
    rows = pairs.select("unit", "left", "right", F.col("score").cast("double").alias("score"))
    units = rows.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("left", "right", "score"))).alias("pairs"))
    return units.mapInPandas(_solve, rows.schema)


def greedy_assignment(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs per ``unit``, highest score first, then the smaller ids.

    Units of at most ``MOST_IN_ROW`` pairs are settled in their own row, larger ones by rounds of joins.
    """
    keyed = pairs.select("unit", "left", "right", "score", F.struct("unit").alias("_k"))
    crowded = cut(keyed.groupBy("_k").agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_ROW).select("_k"))
    if crowded.isEmpty():
        return _row_greedy(keyed)
    return _row_greedy(keyed.join(crowded, "_k", "left_anti")).unionAll(_round_greedy(keyed.join(crowded, "_k", "left_semi")))


def _row_greedy(pairs: DataFrame) -> DataFrame:
    ranked = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("o"), "left", "right")))

    def add(kept, p):
        return F.when(F.exists(kept, lambda k: k["left"].eqNullSafe(p["left"]) | k["right"].eqNullSafe(p["right"])), kept).otherwise(F.concat(kept, F.array(p)))

    lists = pairs.groupBy("unit").agg(ranked.alias("_p"))
    kept = lists.select("unit", F.explode(F.aggregate("_p", F.array().cast(lists.schema["_p"].dataType), add)).alias("k"))
    return kept.select("unit", "k.left", "k.right", (-F.col("k.o")).alias("score"))


def _round_greedy(pairs: DataFrame) -> DataFrame:
    rows = pairs.select(F.struct("unit", "left", "right").alias("owner"), "unit", "left", "right", "score")
    members = rows.select("owner", F.explode(F.array(
        F.struct("unit", F.lit("l").alias("side"), F.col("left").alias("id")),
        F.struct("unit", F.lit("r").alias("side"), F.col("right").alias("id")))).alias("member"))
    ranked = rows.select("owner", F.struct((-F.col("score")).alias("o"), "unit", "left", "right").alias("rank"))
    return greedy_select(members, ranked).select("owner.unit", "owner.left", "owner.right", (-F.col("rank.o")).alias("score"))
