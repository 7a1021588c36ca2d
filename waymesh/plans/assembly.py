"""Corridors from pieces of evidence, fragments of roads by target, partly supported members, forks bound to surfaces, branch variants."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import intervals as I
from ..operators.matching import stable_matching
from ..operators.search import best_paths, longest_chains

PARTIAL_COVERAGE, MOST_COMPLETION_MM, LEAST_RETAINED_MM = 0.5, 20_000, 1_000


def corridor_links(pieces: DataFrame, gap_mm: int) -> DataFrame:
    """``unit, src, dst``: pieces of a unit where one starts at most ``gap_mm`` from where the other ends, in stretches of the axis, not pair by pair.

    ``pieces`` holds ``unit, piece, low, high`` along the unit's axis, both in travel order.
    """
    width = 2 * gap_mm + 1
    ends = pieces.select("unit", F.col("piece").alias("src"), F.col("high").alias("_e"), F.explode(F.array(
        F.floor((F.col("high") - gap_mm) / width), F.floor((F.col("high") + gap_mm) / width))).alias("_c")).distinct()
    starts = pieces.select("unit", F.col("piece").alias("dst"), F.col("low").alias("_s"), F.floor(F.col("low") / width).alias("_c"))
    near = ends.join(starts, ["unit", "_c"]).where((F.abs(F.col("_s") - F.col("_e")) <= gap_mm) & (F.col("src") != F.col("dst")))
    return near.select("unit", "src", "dst").distinct()


def assemble_corridors(pieces: DataFrame, axes: DataFrame, gap_mm: int, least_coverage: float) -> DataFrame:
    """One corridor per unit: ``unit, pieces, observed_mm, coverage, completion, state``.

    ``pieces`` holds ``unit, piece, low, high`` (one direction), ``axes`` ``unit, length_mm``. Pieces must cover ``least_coverage`` of the axis together. Of
    the graph of pieces that follow each other the heaviest chain is taken; pieces in a circle count as one. ``completion`` is the share of the
    corridor, from its first to its last station, that no chosen piece observes.
    """
    real = pieces.where("low < high")
    held = I.covered_length(real.select("unit", "low", "high"), ["unit"]).join(axes, "unit").withColumn("coverage", F.least(F.lit(1.0), F.col("covered_mm") / F.col("length_mm")))
    enough = cut(held.where((F.col("length_mm") > 0) & (F.col("coverage") + 1e-9 >= least_coverage)).select("unit", "coverage"))
    used = cut(real.join(enough, "unit", "left_semi"))
    chain = longest_chains(corridor_links(used, gap_mm), used.select("unit", "piece", (F.col("high") - F.col("low")).alias("weight")))
    members = cut(chain.join(used.select("unit", "piece", "low", "high"), ["unit", "piece"]))
    span = I.covered_length(members.select("unit", "low", "high"), ["unit"]).select("unit", "covered_mm", (F.col("high") - F.col("low")).alias("span_mm"))
    listed = members.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("chain_no", "low", "piece"))).alias("_p"))
    completion = 1 - F.col("covered_mm") / F.col("span_mm")
    # fixed values: states of an assembly
    state = F.when(F.size("_p") == 1, "single_patch_observation").when(F.col("covered_mm") < F.col("span_mm"), "observed_chain_with_constrained_completion").otherwise("multi_patch_median_corridor")
    return listed.join(span, "unit").join(enough, "unit").select(
        "unit", F.transform("_p", lambda p: p["piece"]).alias("pieces"), F.col("covered_mm").alias("observed_mm"), "coverage", completion.alias("completion"), state.alias("state"))


def target_fragments(candidates: DataFrame, roads: DataFrame, least_mm: int) -> DataFrame:
    """Roads cut by the target that claims each part best: ``road_id, fragment_no, low, high, segment_id, member_id, score``.

    ``candidates`` holds ``road_id, low, high, score, segment_id, member_id``; the least score wins, then the smaller ids. Parts without candidate and parts shorter
    than ``least_mm`` are left out; fragments are numbered along the road.
    """
    ranked = candidates.select("road_id", "low", "high", F.struct("score", "segment_id", "member_id").alias("rank"))
    few, many, crowded = I.split_crowded(ranked, F.col("rank.segment_id").isNull() | F.col("rank.member_id").isNull())
    plain = roads if many is None else roads.join(crowded, "road_id", "left_anti")
    # neighbours of one target but different scores are one fragment
    cut_up = I.row_fragments(few, plain, lambda a, b: a["segment_id"].eqNullSafe(b["segment_id"]) & a["member_id"].eqNullSafe(b["member_id"]))
    claimed = cut_up.select("road_id", F.posexplode(F.filter("parts", lambda p: p["best"].isNotNull())).alias("fragment_no", "p"))
    whole = claimed.select("road_id", F.col("fragment_no").cast("long").alias("fragment_no"), "p.low", "p.high", "p.best.segment_id", "p.best.member_id", "p.best.score")
    if many is not None:
        whole = whole.unionByName(_swept_targets(many, roads.join(crowded, "road_id", "left_semi")))
    return whole.where(F.col("high") - F.col("low") >= least_mm)


def _swept_targets(ranked: DataFrame, roads: DataFrame) -> DataFrame:
    """Fragments of roads that very many candidates claim, by sweeps over chunks of their borders."""
    parts = I.swept_fragments(ranked, roads).where(F.col("best").isNotNull())
    labelled = parts.select("road_id", F.col("low").alias("at"), "high", F.col("best.segment_id").alias("segment_id"), F.col("best.member_id").alias("member_id"), F.col("best.score").alias("score"))
    labelled = cut(labelled)
    changed = (F.col("at") != F.col("prev_high")) | (F.col("segment_id") != F.col("prev_segment_id")) | (F.col("member_id") != F.col("prev_member_id"))
    runs = I.sessionize(labelled, "road_id", ["at"], changed, ["high", "segment_id", "member_id"], I.CHUNK_MM, "fragment_no")
    return runs.groupBy("road_id", "fragment_no", "segment_id", "member_id").agg(F.min("at").alias("low"), F.max("high").alias("high"), F.min("score").alias("score"))


def partial_members(members: DataFrame, evidence: DataFrame, full_coverage: float) -> DataFrame:
    """Parts of one-way members with partial evidence: ``member_id, part, low, high``.

    ``members`` holds ``member_id, direction, length_mm, start_on_surface, end_on_surface``, ``evidence`` ``member_id, low, high``. The observed stretch is ``built``; a gap of at
    most 20 m to an end is built too where the surface carries it; other gaps are ``retained_prefix`` and ``retained_suffix``. Members with enough or too little coverage, and
    those that would leave a part of less than 1 m, have no row.
    """
    members = members.where(F.col("direction").isin(2, 3))
    inside = evidence.join(members, "member_id").select("member_id", F.greatest("low", F.lit(0)).alias("low"), F.least("high", "length_mm").alias("high"))
    held = I.covered_length(inside, ["member_id"]).join(members, "member_id")
    share = F.col("covered_mm") / F.col("length_mm")
    held = held.where((share + 1e-9 >= F.least(F.lit(PARTIAL_COVERAGE), F.lit(full_coverage))) & (share + 1e-9 < full_coverage))
    before, behind = F.col("low"), F.col("length_mm") - F.col("high")
    low_missing = F.when(F.col("start_on_surface") & (before <= MOST_COMPLETION_MM), 0).otherwise(before)
    high_missing = F.when(F.col("end_on_surface") & (behind <= MOST_COMPLETION_MM), 0).otherwise(behind)
    held = held.withColumns({"_l": low_missing, "_h": high_missing}).where(
        ~((F.col("_l") > 0) & (F.col("_l") < LEAST_RETAINED_MM)) & ~((F.col("_h") > 0) & (F.col("_h") < LEAST_RETAINED_MM)))
    zero = F.lit(0).cast("long")
    parts = F.array(F.struct(F.lit("built").alias("part"), F.col("_l").alias("low"), (F.col("length_mm") - F.col("_h")).alias("high")),
                    F.when(F.col("_l") > 0, F.struct(F.lit("retained_prefix").alias("part"), zero.alias("low"), F.col("_l").alias("high"))),
                    F.when(F.col("_h") > 0, F.struct(F.lit("retained_suffix").alias("part"), (F.col("length_mm") - F.col("_h")).alias("low"), F.col("length_mm").alias("high"))))
    return held.select("member_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("member_id", "p.*")


def bind_forks(candidates: DataFrame) -> DataFrame:
    """``unit, surface_id, state`` of every candidate (``unit, surface_id, distance_m, priority``): each unit at most one surface and the other way round.

    Units want the nearest surface; a surface keeps the unit of highest priority, then the nearer one. Rivals turned down are ``demoted``.
    """
    worth = F.struct((-F.col("priority")).alias("p"), F.col("distance_m").alias("d"))
    matched = stable_matching(candidates.select(F.col("unit").alias("owner"), F.col("surface_id").alias("place"), F.col("distance_m").alias("wish"), worth.alias("worth")))
    return matched.select(F.col("owner").alias("unit"), F.col("place").alias("surface_id"), "state")


def branch_variants(edges: DataFrame, ends: DataFrame, k: int, limit_m: float) -> DataFrame:
    """The ``k`` best ways of every branch, ranked by length, then road ids; ``cut`` marks branches whose search met the limit."""
    return best_paths(edges, ends, k, limit_m)
