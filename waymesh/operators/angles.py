"""Straightest continuation at a junction, and bundles of road ends by direction."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..lineage import cut
from .graph import greedy_select

# Bundle width, pairing limit and clockwise gap of junction arms, in degrees.
BUNDLE_DEG, PAIR_DEG, CLOCKWISE_DEG = 15.0, 18.0, 80.0
SECTOR_DEG = 15.0


def straightest(incoming: DataFrame, outgoing: DataFrame, keys: list[str]) -> DataFrame:
    """Outgoing road whose direction is nearest to the heading of each incoming road, per ``keys``.

    ``incoming`` holds ``keys, in_id, heading``; ``outgoing`` holds ``keys, out_id, angle``. Headings and
    angles are put in one circular order and each heading meets only the neighbours on both sides; the
    order is taken sector by sector, so a junction with very many roads is spread over several tasks.
    """
    edges = outgoing.groupBy(*keys, "angle").agg(F.min("out_id").alias("out_id"))
    hit = F.struct(F.col("angle").alias("a"), F.col("out_id").alias("o"))
    places = edges.select(*keys, F.col("angle").alias("at"), hit.alias("edge"))
    probes = incoming.select(*keys, F.col("heading").alias("at"), F.lit(None).cast(places.schema["edge"].dataType).alias("edge"), "in_id")
    line = probes.unionByName(places, allowMissingColumns=True).withColumn("_sector", F.floor(F.col("at") / SECTOR_DEG))
    sector = Window.partitionBy(*keys, "_sector")
    # both frames grow row by row; one that begins at the row itself would be gone through anew for each
    before = sector.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    after = sector.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    local = line.withColumns({"_b": F.last("edge", True).over(before), "_a": F.last("edge", True).over(after)}).where(F.col("in_id").isNotNull())
    every = line.groupBy(*keys, "_sector").agg(F.min("edge").alias("_first"), F.max("edge").alias("_last"))
    whole = Window.partitionBy(*keys)
    ring = whole.orderBy("_sector")
    carried = every.select(*keys, "_sector", F.min("_first").over(whole).alias("lo"), F.max("_last").over(whole).alias("hi"),
                           F.last("_last", True).over(ring.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
                           F.first("_first", True).over(ring.rowsBetween(1, Window.unboundedFollowing)).alias("_ca")).where(F.col("lo").isNotNull())
    joined = local.join(carried, [*keys, "_sector"])
    below, above = F.coalesce("_b", "_cb", "hi"), F.coalesce("_a", "_ca", "lo")

    def option(edge):
        return F.struct(G.angular_distance(F.col("at"), edge["a"]).alias("turn_deg"), edge["o"].alias("out_id"))

    return joined.select(*keys, "in_id", F.least(option(below), option(above)).alias("best")).select(
        *keys, "in_id", "best.out_id", "best.turn_deg")


def _bundles(ends: DataFrame) -> DataFrame:
    """Directions of one role that follow each other without a gap of more than BUNDLE_DEG around the circle.

    A run wider than twice that, as at a hub, is split evenly, so no bundle reaches further than BUNDLE_DEG from its middle.
    """
    spots = ends.where(F.col("angle").isNotNull()).groupBy("junction_id", "role", "angle").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    around = Window.partitionBy("junction_id", "role").orderBy("angle")
    whole = Window.partitionBy("junction_id", "role")
    step = F.col("angle") - F.lag("angle").over(around)
    cut_here = spots.withColumns({"_cut": F.coalesce(step > BUNDLE_DEG, F.lit(False)).cast("int"),
                                  "_seam": F.min("angle").over(whole) + 360.0 - F.max("angle").over(whole)})
    islands = cut_here.withColumn("_island", F.sum("_cut").over(around))
    seam = (F.col("_seam") <= BUNDLE_DEG) & (F.col("_island") > 0) & (F.col("_island") == F.max("_island").over(whole))
    unrolled = islands.withColumn("_at", F.when(seam, F.col("angle") - 360.0).otherwise(F.col("angle"))).withColumn("_island", F.when(seam, 0).otherwise(F.col("_island")))
    one = Window.partitionBy("junction_id", "role", "_island")
    spread = unrolled.withColumns({"_low": F.min("_at").over(one), "_span": F.max("_at").over(one) - F.min("_at").over(one)})
    parts = F.greatest(F.ceil(F.col("_span") / (2 * BUNDLE_DEG)), F.lit(1))
    closed = spread.withColumn("_part", F.when(F.col("_span") > 0, F.least(F.floor((F.col("_at") - F.col("_low")) / F.col("_span") * parts), parts - 1)).otherwise(0))
    rad = F.radians("angle")
    return closed.groupBy("junction_id", "role", "_island", "_part").agg(
        F.sum(F.col("n") * F.sin(rad)).alias("_s"), F.sum(F.col("n") * F.cos(rad)).alias("_c"), F.sum("n").alias("n"), F.min("first_id").alias("first_id")).select(
        "junction_id", "role", F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)).alias("mean_deg"), "n", "first_id")


def _matched(pairs: DataFrame) -> DataFrame:
    """Pairs of an outbound and an inbound bundle, narrowest first, no bundle twice."""
    owner = F.struct("junction_id", "out_id", "in_id")
    members = pairs.select(owner.alias("owner"), F.explode(F.array(
        F.struct("junction_id", F.lit("o").alias("side"), F.col("out_id").alias("id")),
        F.struct("junction_id", F.lit("i").alias("side"), F.col("in_id").alias("id")))).alias("member"))
    ranked = pairs.select(owner.alias("owner"), F.struct("width", "junction_id", "out_id", "in_id").alias("rank"))
    return greedy_select(members, ranked).select("owner.*")


def bundle_arms(ends: DataFrame) -> DataFrame:
    """Arms of junctions: ends of one role bundled by direction, then outbound paired with inbound bundles.

    ``ends`` comes from ``incident_ends``. A junction has at most 24 bundles of a role, however many roads it has. First bundles within PAIR_DEG are paired, then an outbound one with an inbound one
    up to CLOCKWISE_DEG further round, unless another outbound one lies between.
    """
    bundles = cut(_bundles(ends))
    outs = bundles.where(F.col("role") == "outbound").select("junction_id", F.col("first_id").alias("out_id"), F.col("mean_deg").alias("out_deg"), F.col("n").alias("out_n"))
    ins = bundles.where(F.col("role") == "inbound").select("junction_id", F.col("first_id").alias("in_id"), F.col("mean_deg").alias("in_deg"), F.col("n").alias("in_n"))
    near = outs.join(ins, "junction_id").withColumn("width", G.angular_distance(F.col("out_deg"), F.col("in_deg"))).where(F.col("width") <= PAIR_DEG)
    first = cut(_matched(near))
    free_outs, free_ins = outs.join(first, ["junction_id", "out_id"], "left_anti"), ins.join(first, ["junction_id", "in_id"], "left_anti")
    other = outs.select("junction_id", F.col("out_id").alias("_o"), F.col("out_deg").alias("_d"))
    next_out = free_outs.join(other, "junction_id").where("out_id != _o").groupBy("junction_id", "out_id").agg(
        F.min(F.pmod(F.col("_d") - F.col("out_deg"), F.lit(360.0))).alias("until"))
    onward = free_outs.join(next_out, ["junction_id", "out_id"], "left").join(free_ins, "junction_id").withColumn(
        "width", F.pmod(F.col("in_deg") - F.col("out_deg"), F.lit(360.0)))
    second = _matched(onward.where((F.col("width") > 0) & (F.col("width") <= CLOCKWISE_DEG) & (F.col("width") < F.coalesce("until", F.lit(360.0)))))
    pairs = cut(first.unionByName(second))
    both = pairs.join(outs, ["junction_id", "out_id"]).join(ins, ["junction_id", "in_id"]).select(
        "junction_id", F.lit("bidirectional").alias("arm_role"), F.col("out_deg").alias("mean_deg"), (F.col("out_n") + F.col("in_n")).alias("roads"),
        F.least("out_id", "in_id").alias("first_road_id"))
    taken = pairs.select("junction_id", F.lit("outbound").alias("role"), F.col("out_id").alias("first_id")).unionByName(
        pairs.select("junction_id", F.lit("inbound").alias("role"), F.col("in_id").alias("first_id")))
    alone = bundles.join(taken, ["junction_id", "role", "first_id"], "left_anti").select(
        "junction_id", F.col("role").alias("arm_role"), "mean_deg", F.col("n").alias("roads"), F.col("first_id").alias("first_road_id"))
    arms = both.unionByName(alone).withColumn("mean_deg", F.round("mean_deg", 3))
    number = F.row_number().over(Window.partitionBy("junction_id").orderBy("mean_deg", "first_road_id", "arm_role"))
    return arms.select("junction_id", number.alias("arm_no"), "arm_role", "mean_deg", "roads", "first_road_id")
