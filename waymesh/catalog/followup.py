"""Follow-up tables."""
from pyspark.sql import functions as F

from ..plans import followup as FU
from ..plans.lanes import access_audit
from .registry import query
from .replacement import lookup


@query("validation_summary", "SELECT coalesce(reason, 'passed') AS status, count(*) AS n FROM lookup GROUP BY 1")
def _(v):
    return lookup(v).groupBy(F.coalesce("reason", F.lit("passed")).alias("status")).agg(F.count("*").alias("n"))


@query("relation_fallback", "SELECT target_id, CASE WHEN min(b) IS NULL THEN 'no_carrier' WHEN min(b) = max(b) THEN 'success' ELSE 'several_carriers' END AS state, CASE WHEN min(b) = max(b) THEN min(b) END AS base_id FROM (SELECT target_id, CASE WHEN status = 0 AND base_id % 9 = 0 THEN base_id END AS b FROM relations) GROUP BY 1")
def _(v):
    return FU.relation_fallback(v.relations.select("target_id", F.when((F.col("status") == 0) & (F.col("base_id") % 9 == 0), F.col("base_id")).alias("base_id")))


@query("old_road_groups", "SELECT o_custkey AS old_road, count(*) AS lanes, CASE WHEN min(w) IS NULL THEN 'none' WHEN min(w) = max(w) THEN 'single' ELSE 'mixed' END AS mix FROM (SELECT o_custkey, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 3 END AS w FROM orders) GROUP BY 1")
def _(v):
    return FU.owner_mix(v.orders.select(F.col("o_custkey").alias("old_road"), F.when(F.col("o_orderkey") % 8 == 0, F.col("o_orderkey") % 3).alias("owner")))


@query("incremental_replan", "SELECT DISTINCT l_orderkey AS segment_id FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'")
def _(v):
    rows = v.lineitem.select(F.col("l_orderkey").alias("segment_id"), F.col("l_partkey").cast("string").alias("p"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    before = rows.withColumn("f", F.when((F.col("f") == "A") & (F.col("s") == "O"), "changed").otherwise(F.col("f")))
    return FU.changed_segments(FU.fingerprints(rows, ["p", "f"]), FU.fingerprints(before, ["p", "f"]))


@query("junction_structure_audit", """WITH a AS (SELECT DISTINCT segment_id, role FROM seg_nodes), b AS (SELECT DISTINCT segment_id, role FROM seg_nodes WHERE node_id % 2 = 0) SELECT coalesce(a.segment_id, b.segment_id) AS junction_id, coalesce(a.role, b.role) AS role,
    CASE WHEN b.role IS NULL THEN 'missing' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.segment_id = b.segment_id AND a.role = b.role""")
def _(v):
    rows = v.seg_nodes.withColumnRenamed("segment_id", "junction_id")
    return access_audit(rows, rows.where("node_id % 2 = 0"))
