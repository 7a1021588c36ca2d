"""Group aggregates over road layers. Lists stay long tables of members; groups carry only counts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import first_per_key


def junction_groups(aliases: DataFrame) -> DataFrame:
    """Size and representative of every junction; members are the rows of ``aliases``."""
    return aliases.groupBy("canonical_id").agg(F.count("*").alias("members"), F.min("node_id").alias("first_member"),
                                               (F.count("*") == 1).alias("is_single"))


def covered_groups(aliases: DataFrame, covered_nodes: DataFrame) -> DataFrame:
    """Junctions all of whose members are covered."""
    flagged = aliases.join(covered_nodes.select("node_id").distinct().withColumn("_hit", F.lit(True)), "node_id", "left")
    return flagged.groupBy("canonical_id").agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("all_covered"),
                                               F.count("*").alias("members"), F.count("_hit").alias("covered_members"))


def road_ends(roads: DataFrame) -> DataFrame:
    """Directed ends of roads on junctions: one row per road and end with ``goes_in`` and ``goes_out``."""
    both = F.col("direction").isin(0, 1)
    forward, backward = both | (F.col("direction") == 2), both | (F.col("direction") == 3)
    return roads.select("*", F.explode(F.array(
        F.struct(F.col("src").alias("junction_id"), backward.alias("goes_in"), forward.alias("goes_out")),
        F.struct(F.col("dst").alias("junction_id"), forward.alias("goes_in"), backward.alias("goes_out")))).alias("_e")).select(
        "*", "_e.*").drop("_e")


def in_out_degree(roads: DataFrame) -> DataFrame:
    """Ways into and out of each junction; a road inside a junction counts on both of its ends."""
    return road_ends(roads).groupBy("junction_id").agg(
        F.count_if("goes_in").alias("in_degree"), F.count_if("goes_out").alias("out_degree"))


def incident_degree(roads: DataFrame, excluded_bits: int) -> DataFrame:
    """Roads at a junction, without roads that carry an excluded bit and without inner roads."""
    usable = roads.where((F.col("formway").bitwiseAND(excluded_bits) == 0) & (F.col("src") != F.col("dst")))
    return usable.select(F.explode(F.array("src", "dst")).alias("junction_id")).groupBy("junction_id").agg(
        F.count("*").alias("degree"))


def cardinality_errors(relations: DataFrame) -> DataFrame:
    """Successful relations that are not one to one, as one row per error and related pair.

    ``one_target_to_many_base`` and ``many_target_to_one_base`` list every pair concerned;
    ``duplicate_target_rows`` carries the number of rows of the target.
    """
    success = relations.where((F.col("status") == 0) & (F.col("base_id") > 0)).select("target_id", "base_id")
    pairs = success.groupBy("target_id", "base_id").agg(F.count("*").alias("n"))
    by_target = pairs.groupBy("target_id").agg(F.count("*").alias("bases"), F.sum("n").alias("rows"))
    by_base = pairs.groupBy("base_id").agg(F.count("*").alias("targets"))
    many_bases = pairs.join(by_target.where(F.col("bases") > 1), "target_id")
    many_targets = pairs.join(by_base.where(F.col("targets") > 1), "base_id")
    duplicates = by_target.where(F.col("rows") > 1)
    return (many_bases.select(F.lit("one_target_to_many_base").alias("error_type"), "target_id", "base_id", F.col("bases").alias("n"))
            .unionAll(many_targets.select(F.lit("many_target_to_one_base"), "target_id", "base_id", F.col("targets")))
            .unionAll(duplicates.select(F.lit("duplicate_target_rows"), "target_id", F.lit(None).cast("bigint"), F.col("rows"))))


def without_blocked_targets(relations: DataFrame, errors: DataFrame) -> DataFrame:
    """Relations whose target is free of blocking errors."""
    blocking = errors.where(F.col("error_type").isin("one_target_to_many_base", "duplicate_target_rows"))
    return relations.join(blocking.select("target_id").distinct(), "target_id", "left_anti")


def share_by_class(df: DataFrame, classes: list[str], length: str, subset: Column) -> DataFrame:
    """Count, length and its share of all and of a subset, for every value of every class column."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in classes], F.col(length).alias("_len"),
                     F.when(subset, F.col(length)).otherwise(0).alias("_sub"))
    grouped = rows.groupingSets([[c] for c in classes] + [[]], *classes).agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("n"), F.sum("_len").alias("length_m"), F.sum("_sub").alias("subset_m"))
    full = (1 << len(classes)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(classes):
        here = F.col("_gid") == full - (1 << (len(classes) - 1 - i))
        name, value = F.when(here, F.lit(c)).otherwise(name), F.when(here, F.col(c)).otherwise(value)
    labelled = grouped.select(name.alias("class_name"), value.alias("class_value"), "n", "length_m", "subset_m", "_gid")
    total = labelled.where(F.col("_gid") == full).select(F.col("length_m").alias("_all"), F.col("subset_m").alias("_all_sub"))
    # the total is one row, so this broadcast has a fixed size
    return labelled.where(F.col("_gid") != full).join(F.broadcast(total)).select(
        "class_name", "class_value", "n", "length_m", F.round(F.col("length_m") / F.col("_all"), 6).alias("share"),
        F.round(F.when(F.col("_all_sub") > 0, F.col("subset_m") / F.col("_all_sub")), 6).alias("subset_share"))


def dominant_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most common value per key; ties go to the smaller one."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("votes"))
    return first_per_key(counted, [key], [F.col("votes").desc(), F.col(value)])


def multiset_f1(predicted: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """Precision, recall and F1 over bags of rows."""
    a = predicted.groupBy(*columns).agg(F.count("*").alias("_p"))
    b = truth.groupBy(*columns).agg(F.count("*").alias("_t"))
    both = a.join(b, columns, "full_outer").agg(
        F.sum(F.coalesce("_p", F.lit(0))).alias("predicted"), F.sum(F.coalesce("_t", F.lit(0))).alias("truth"),
        F.sum(F.least(F.coalesce("_p", F.lit(0)), F.coalesce("_t", F.lit(0)))).alias("matched"))
    precision = F.when(F.col("predicted") > 0, F.col("matched") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("truth") > 0, F.col("matched") / F.col("truth")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return both.select("predicted", "truth", "matched", F.round(precision, 6).alias("precision"),
                       F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))
