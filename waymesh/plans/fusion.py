"""Fusion of junction surfaces from several sources."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

# Sources in order of precedence, the kinds each virtual source leads for, largest union gap.
SOURCE_ORDER = ("T03", "T04", "T02_INPUT")
T03_KINDS, T04_KINDS = (4, 2048), (8, 16, 128)
UNION_GAP_M = 2.0


def fuse_surfaces(surfaces: DataFrame, cell: float = 1.0) -> DataFrame:
    """One fused surface per junction: primary surface, action, conflict reasons and covered cells.

    ``surfaces`` holds ``surface_id, mainnodeid, patch_id, kind_2, source, ring``. Surfaces of several
    sources are united when the widest gap between their boxes along either axis is within the limit.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    box = G.bounds(F.col("ring"))
    rank = F.struct(order.alias("o"), F.col("surface_id").alias("i"))

    def first(source: str):
        return F.min(F.when(F.col("source") == source, F.col("surface_id")))

    groups = surfaces.groupBy("mainnodeid").agg(
        F.count("*").alias("surface_count"), F.count_distinct("source").alias("source_count"),
        F.min_by("kind_2", F.when(F.col("kind_2").isNotNull(), rank)).alias("first_kind"),
        first("T03").alias("t03"), first("T04").alias("t04"), F.min_by("surface_id", rank).alias("by_order"),
        (F.min("kind_2") != F.max("kind_2")).alias("kind_conflict"), (F.min("patch_id") != F.max("patch_id")).alias("patch_conflict"),
        F.greatest(F.max(box["minx"]) - F.min(box["maxx"]), F.max(box["miny"]) - F.min(box["maxy"])).alias("gap"))
    both = F.col("t03").isNotNull() & F.col("t04").isNotNull()
    primary = (F.when(both & F.col("first_kind").isin(*T03_KINDS), F.col("t03"))
               .when(both & F.col("first_kind").isin(*T04_KINDS), F.col("t04")).otherwise(F.col("by_order")))
    unite = (F.col("source_count") > 1) & (F.col("gap") <= UNION_GAP_M)
    action = F.when(F.col("source_count") == 1, "single_source").when(unite, "union").otherwise("primary_only")
    reasons = F.concat_ws("|", F.when(both, "t03_t04_same_mainnodeid"), F.when(F.col("kind_conflict"), "kind_2_conflict"),
                          F.when(F.col("patch_conflict"), "patch_id_conflict"))
    decided = groups.select("mainnodeid", "surface_count", primary.alias("primary_id"), action.alias("action"), reasons.alias("reasons"))
    used = surfaces.select("mainnodeid", "surface_id", "ring").join(decided.select("mainnodeid", "primary_id", "action"), "mainnodeid").where(
        (F.col("action") == "union") | (F.col("surface_id") == F.col("primary_id")))
    cells = used.select("mainnodeid", F.explode(G.cells_of_ring(F.col("ring"), cell)).alias("c")).distinct()
    return decided.join(cells.groupBy("mainnodeid").agg(F.count("*").alias("cells")), "mainnodeid", "left")
