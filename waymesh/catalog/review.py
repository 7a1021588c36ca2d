"""Review lists, cases and manual decisions."""
from pyspark.sql import functions as F

from ..operators.topk import full_rank, top_k
from ..plans import review as RV
from .joins import relation_last
from .registry import query
from .replacement import lookup


@query("repair_candidates", "SELECT node_id AS target_id, count(*) AS evidence_rows, count(DISTINCT segment_id) AS segments FROM seg_nodes JOIN lookup USING (segment_id) WHERE reason IS NOT NULL GROUP BY 1")
def _(v):
    gaps = v.seg_nodes.join(lookup(v).where("NOT passed").select("segment_id"), "segment_id", "left_semi")
    return RV.repair_candidates(gaps)


@query("review_priority", """WITH s AS (SELECT segment_id, bool_and(node_id % 4 <> 0 OR node_id % 3 = 0) AS every, bool_or(node_id % 4 <> 0 OR node_id % 3 = 0) AS partly FROM seg_nodes GROUP BY 1)
    SELECT segment_id, CASE WHEN every THEN '0_all_nodes_have_context' WHEN partly THEN '1_partial_context' ELSE '2_no_context' END AS bucket FROM s""")
def _(v):
    return RV.review_priority(v.seg_nodes.select("segment_id", ((F.col("node_id") % 4 != 0) | (F.col("node_id") % 3 == 0)).alias("has_context")))


@query("relation_gap_class", """SELECT target_id, CASE WHEN status = 0 AND base_id > 0 AND base_id % 3 > 0 AND target_id % 5 > 0 THEN 'already_machine_consumable' WHEN status = 0 AND base_id > 0 AND base_id % 3 > 0 THEN 'manual_consumed_graph_consumable'
    WHEN status = 0 AND base_id > 0 THEN 'relation_success_but_graph_unconsumable' WHEN status <> 0 THEN 'manual_can_fix_machine_relation_failure' ELSE 'manual_relation_needs_review' END AS gap_class FROM relation_last""")
def _(v):
    return RV.gap_class(relation_last(v).select("target_id", "base_id", "status", (F.col("base_id") % 3 > 0).alias("consumable"), (F.col("target_id") % 5 == 0).alias("manual")))


@query("root_cause_priority", "SELECT reason, segments, CAST(row_number() OVER (ORDER BY segments DESC, reason) AS INTEGER) AS rank_no FROM (SELECT reason, count(*) AS segments FROM lookup WHERE reason IS NOT NULL GROUP BY 1)")
def _(v):
    counted = lookup(v).where("NOT passed").groupBy("reason").agg(F.count("*").alias("segments")).withColumn("_all", F.lit(1))
    return full_rank(counted, "_all", "segments", "reason").select("reason", "segments", "rank_no")


@query("manual_apply", """WITH m AS (SELECT l_partkey AS target_id, l_suppkey AS base_id, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem WHERE l_linenumber = 7) SELECT target_id, base_id, CASE WHEN n > 1 THEN 'duplicate_target' WHEN base_id = 0 THEN 'rejected_no_base' WHEN target_id NOT IN (SELECT target_id FROM relations) THEN 'rejected_unknown_target'
    ELSE 'actionable' END AS state FROM m""")
def _(v):
    rows = v.lineitem.where("l_linenumber = 7").select(F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("base_id"))
    return RV.manual_apply(rows, v.relations.select("target_id").distinct())


@query("metrics_compare", "SELECT coalesce(a.k, b.k) AS metric, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def _(v):
    def run(status):
        return v.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("n"))
    return RV.metrics_compare(run("F"), run("O"))


@query("case_suggest", "SELECT target_id AS case_id, n AS evidence_rows, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (ORDER BY n DESC, target_id) AS rn FROM (SELECT node_id AS target_id, count(*) AS n FROM seg_nodes GROUP BY 1)) WHERE rn <= 20")
def _(v):
    counted = v.seg_nodes.groupBy(F.col("node_id").alias("case_id")).agg(F.count("*").alias("evidence_rows")).withColumn("_all", F.lit(1))
    return top_k(counted, ["_all"], [F.col("evidence_rows").desc(), F.col("case_id")], 20).select("case_id", "evidence_rows", "rank_no")


@query("case_slice", """WITH c AS (SELECT id FROM net_nodes WHERE (x - 500) * (x - 500) + (y - 500) * (y - 500) <= 40000 UNION SELECT s_suppkey + 1 FROM supplier WHERE s_nationkey = 3) SELECT id AS road_id FROM net_roads WHERE snodeid IN (SELECT id FROM c) OR enodeid IN (SELECT id FROM c)""")
def _(v):
    forced = v.supplier.where("s_nationkey = 3").select((F.col("s_suppkey") + 1).alias("id"))
    return RV.case_slice(v.net_nodes, v.net_roads, 500.0, 500.0, 200.0, forced)
