"""Intervals along roads: sweeps and stabbing queries that spread one long road, or one place that very many intervals cover.

Measures are whole millimetres (``at``, ``low``, ``high``: long), so intervals fall into dyadic cells: an interval is the union of at most
two cells of every size, and a place lies in one cell of every size. A cell keeps one row, the best of all intervals that have it among
their cells, so neither pairs of intervals nor pairs of intervals and places are made.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .ordered import sessionize, with_previous

LEVELS = 40
MOST_IN_ROW = 64
CHUNK_MM = 1_000_000.0


def millimetres(metres):
    return F.round(F.col(metres) * 1000).cast("long")


def dyadic_cells(low, high):
    """Cells (``level``, ``cell``) whose union is [low, high); cell c of level l is [c * 2**l, (c + 1) * 2**l)."""
    def step(state, level):
        left, right = state["left"], state["right"]
        open_ = left < right
        take_left, take_right = open_ & (left % 2 == 1), open_ & (right % 2 == 1)
        taken = F.filter(F.array(F.when(take_left, F.struct(level.alias("level"), left.alias("cell"))), F.when(take_right, F.struct(level.alias("level"), (right - 1).alias("cell")))),
                         lambda c: c.isNotNull())
        next_left = F.shiftright(F.when(take_left, left + 1).otherwise(left), 1)
        next_right = F.shiftright(F.when(take_right, right - 1).otherwise(right), 1)
        return F.struct(next_left.alias("left"), next_right.alias("right"), F.concat(state["cells"], taken).alias("cells"))

    empty = F.array().cast("array<struct<level:int,cell:bigint>>")
    start = F.struct(low.alias("left"), high.alias("right"), empty.alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["cells"]


def best_at(places: DataFrame, intervals: DataFrame) -> DataFrame:
    """``places`` (``road_id, at``) with ``best``: the least ``rank`` of the intervals (``road_id, low, high, rank``) that hold them, null where none does.

    ``rank`` may be a struct; intervals are half-open.
    """
    cells = intervals.where("low < high").select("road_id", "rank", F.explode(dyadic_cells(F.col("low"), F.col("high"))).alias("c")).groupBy(
        "road_id", "c.level", "c.cell").agg(F.min("rank").alias("rank"))
    spots = places.select("road_id", "at").distinct()
    asked = spots.select("road_id", "at", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    asked = asked.withColumn("cell", F.expr("shiftright(at, level)"))
    found = asked.join(cells, ["road_id", "level", "cell"]).groupBy("road_id", "at").agg(F.min("rank").alias("best"))
    return places.join(found, ["road_id", "at"], "left")


def split_crowded(intervals: DataFrame, odd=None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Intervals of roads that fit in one row, those of roads that do not (None if there are none), and the ``road_id`` of the latter.

    Roads with more than ``MOST_IN_ROW`` intervals are crowded, and those with an interval that ``odd`` marks.
    """
    sizes = intervals.groupBy("road_id").agg(F.count("*").alias("n"), F.bool_or(F.lit(False) if odd is None else odd).alias("odd"))
    crowded = cut(sizes.where((F.col("n") > MOST_IN_ROW) | F.col("odd")).select("road_id"))
    if crowded.isEmpty():
        return intervals, None, crowded
    return intervals.join(crowded, "road_id", "left_anti"), intervals.join(crowded, "road_id", "left_semi"), crowded


def row_fragments(intervals: DataFrame, roads: DataFrame, same) -> DataFrame:
    """``road_id, parts`` of roads with few intervals, each road in its own row; ``parts`` are ``low, high, best`` along the road.

    Neighbours for whose labels ``same`` holds are one part and have their least label.
    """
    lists = intervals.groupBy("road_id").agg(F.collect_list(F.struct("low", "high", "rank")).alias("_i"))
    clipped = F.transform("_i", lambda i: F.struct(F.greatest(i["low"], F.lit(0)).cast("long").alias("low"), F.least(i["high"], F.col("length_mm")).cast("long").alias("high"), i["rank"].alias("rank")))
    rows = roads.join(lists, "road_id", "left").select("road_id", "length_mm", F.filter(clipped, lambda i: i["low"] < i["high"]).alias("_i"))
    none = F.array().cast("array<bigint>")
    ends = F.when(F.col("length_mm") > 0, F.array(F.lit(0).cast("long"), F.col("length_mm").cast("long"))).otherwise(none)
    marks = F.array_sort(F.array_distinct(F.concat(F.coalesce(F.transform("_i", lambda i: i["low"]), none), F.coalesce(F.transform("_i", lambda i: i["high"]), none), ends)))
    rows = rows.select("road_id", "_i", marks.alias("_m")).where(F.size("_m") > 1)
    n = F.size("_m") - 1
    steps = F.zip_with(F.slice("_m", F.lit(1), n), F.slice("_m", F.lit(2), n), lambda a, b: F.struct(a.alias("at"), b.alias("high"), F.array_min(
        F.transform(F.filter("_i", lambda i: (i["low"] <= a) & (i["high"] >= b)), lambda i: i["rank"])).alias("best")))
    rows = rows.select("road_id", steps.alias("_s"))
    firsts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | ~same(F.get("_s", i)["best"], F.get("_s", i - 1)["best"]))
    rows = rows.select("road_id", "_s", firsts.alias("_f"))

    def part(i, k):
        behind = F.coalesce(F.get("_f", k + 1), F.size("_s"))
        return F.struct(F.get("_s", i)["at"].alias("low"), F.get("_s", behind - 1)["high"].alias("high"),
                        F.array_min(F.transform(F.slice("_s", i + 1, behind - i), lambda s: s["best"])).alias("best"))

    return rows.select("road_id", F.transform("_f", part).alias("parts"))


def fragments(intervals: DataFrame, roads: DataFrame) -> DataFrame:
    """Every road cut where its best label changes: ``road_id, low, high, best``; fragments cover a road once, without gap or overlap.

    ``intervals`` holds ``road_id, low, high, rank`` (a struct that ends in the label; the least one wins), ``roads`` ``road_id, length_mm``.
    Where no interval lies ``best`` is null. A road with few intervals is cut within its row; the others are swept.
    """
    few, many, crowded = split_crowded(intervals)
    plain = roads if many is None else roads.join(crowded, "road_id", "left_anti")
    found = row_fragments(few, plain, lambda a, b: a.eqNullSafe(b)).select("road_id", F.inline("parts"))
    return found if many is None else found.unionByName(swept_fragments(many, roads.join(crowded, "road_id", "left_semi")))


def swept_fragments(intervals: DataFrame, roads: DataFrame) -> DataFrame:
    """``fragments`` of roads with any number of intervals: borders are swept in chunks, so one long road spans many tasks."""
    inside = intervals.join(roads, "road_id").select("road_id", F.greatest("low", F.lit(0)).alias("low"), F.least("high", "length_mm").alias("high"), "rank")
    marks = inside.where("low < high").select("road_id", F.explode(F.array("low", "high")).alias("at"))
    marks = marks.unionAll(roads.where("length_mm > 0").select("road_id", F.explode(F.array(F.lit(0).cast("long"), F.col("length_mm"))).alias("at"))).distinct()
    steps = with_previous(marks, "road_id", ["at"], ["at"], CHUNK_MM).where("prev_at IS NOT NULL").select(
        "road_id", F.col("prev_at").alias("at"), F.col("at").alias("high"))
    labelled = cut(best_at(cut(steps), inside))  # the sweep below reads it several times
    changed = ~F.col("best").eqNullSafe(F.col("prev_best"))
    numbered = sessionize(labelled, "road_id", ["at"], changed, ["best"], CHUNK_MM)
    return numbered.groupBy("road_id", "part_no").agg(F.min("at").alias("low"), F.max("high").alias("high"), F.first("best").alias("best")).drop("part_no")


def covered_length(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, covered_mm, low, high``: the length of the union of each key's intervals (``low, high``), from 0 on, and its ends.

    Few intervals are added up within a row, many are swept.
    """
    real = intervals.where("low < high").select(F.struct(*keys).alias("road_id"), "low", "high")
    few, many, crowded = split_crowded(real)

    def add(state, i):
        reached = F.greatest(state["high"], i["high"].cast("long"))
        return F.struct(reached.alias("high"), (state["mm"] + F.greatest(F.lit(0).cast("long"), i["high"] - F.greatest(i["low"], state["high"]))).alias("mm"))

    zero = F.lit(0).cast("long")
    mm = F.aggregate(F.array_sort("_i"), F.struct(zero.alias("high"), zero.alias("mm")), add)["mm"]
    ends = F.max("high").alias("length_mm"), F.min("low").alias("first")
    held = few.groupBy("road_id").agg(F.collect_list(F.struct("low", "high")).alias("_i"), *ends).select("road_id", mm.alias("covered_mm"), "length_mm", "first").where("covered_mm > 0")
    if many is not None:
        whole = many.groupBy("road_id").agg(*ends)
        swept = swept_fragments(many.withColumn("rank", F.lit(1)), whole.select("road_id", "length_mm")).where("best IS NOT NULL").groupBy("road_id").agg(
            F.sum(F.col("high") - F.col("low")).alias("covered_mm"))
        held = held.unionByName(swept.join(whole, "road_id"))
    return held.select("road_id.*", "covered_mm", F.col("first").alias("low"), F.col("length_mm").alias("high"))
