"""Quality audit."""
from pyspark.sql import functions as F

from ..operators import graph as GR
from ..plans import quality as QA
from .anchors import anchor_result, junction_hits
from .graphs import chain_edges, end_pairs
from .registry import query
from .replacement import _WAYS


@query("carrier_equivalence", "SELECT o_orderkey AS path_id, round(CASE WHEN o_custkey % 97 > 0 THEN CAST(o_orderkey % 200 AS DOUBLE) / (o_custkey % 97) END, 6) AS ratio, o_orderkey % 200 = 0 OR (o_custkey % 97 > 0 AND CAST(o_orderkey % 200 AS DOUBLE) / (o_custkey % 97) <= 1.5 AND o_orderkey % 200 - o_custkey % 97 <= 100 AND o_orderkey % 80 <= 50) AS accepted FROM orders")
def _(v):
    o = F.col("o_orderkey")
    return QA.carrier_equivalence(v.orders.select(o.alias("path_id"), (o % 200).alias("length_m"), (F.col("o_custkey") % 97).alias("reference_m"), (o % 80).alias("max_distance_m")))


@query("missing_direction_audit", f"WITH {_WAYS} SELECT unit, 'pair1_to_pair0' AS direction, 'segment_required_direction_unavailable' AS issue_type FROM w WHERE NOT bw UNION ALL SELECT unit, 'pair0_to_pair1', 'segment_required_direction_unavailable' FROM w WHERE NOT fw")
def _(v):
    edges = chain_edges(v)
    return QA.missing_directions(GR.both_ways(edges), GR.directed_edges(edges), end_pairs(v))


@query("reverse_carrier_audit", f"WITH {_WAYS} SELECT unit, CASE WHEN fw THEN 'pair1_to_pair0' ELSE 'pair0_to_pair1' END AS direction FROM w WHERE fw <> bw")
def _(v):
    edges = chain_edges(v)
    return QA.unexpected_reverse(GR.directed_edges(edges), GR.both_ways(edges), end_pairs(v))


@query("decision_publish", """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 200 = 0 OR (o_custkey % 97 > 0 AND CAST(o_orderkey % 200 AS DOUBLE) / (o_custkey % 97) <= 1.5 AND o_orderkey % 200 - o_custkey % 97 <= 100 AND o_orderkey % 80 <= 50) AS same,
    coalesce(is_anchor, '') <> 'yes' AS weak FROM orders LEFT JOIN anchor_result ON junction_id = o_custkey + 1), o AS (SELECT doc_id AS id, min(CASE WHEN quality = 1 THEN 'manual' WHEN toxic = 1 THEN 'confirmed' ELSE 'excluded' END) AS st FROM labels GROUP BY 1)
    SELECT c.id AS candidate_id, coalesce(st, CASE WHEN same OR weak THEN 'excluded' ELSE 'confirmed' END) AS decision, CASE WHEN st IS NOT NULL THEN 'external_review_override' WHEN same THEN 'equivalent_raw_carrier'
    WHEN weak THEN 'insufficient_anchor_confidence' ELSE 'raw_carrier_missing_trusted_anchor' END AS rule FROM c LEFT JOIN o USING (id)""")
def _(v):
    o = F.col("o_orderkey")
    paths = v.orders.select(o.alias("path_id"), (o % 200).alias("length_m"), (F.col("o_custkey") % 97).alias("reference_m"), (o % 80).alias("max_distance_m"))
    same = QA.carrier_equivalence(paths).select(F.col("path_id").alias("candidate_id"), F.col("accepted").alias("equivalent"))
    trust = anchor_result(v).select("junction_id", F.when(F.col("is_anchor") == "yes", "standard_surface").alias("anchor_confidence"))
    rows = v.orders.select(o.alias("candidate_id"), (F.col("o_custkey") + 1).alias("junction_id")).join(trust, "junction_id", "left").join(same, "candidate_id")
    status = F.when(F.col("quality") == 1, "manual").when(F.col("toxic") == 1, "confirmed").otherwise("excluded")
    return QA.publish_decisions(rows, v.labels.select(F.col("doc_id").alias("candidate_id"), status.alias("status")))


_ISSUE_ROWS = ", ".join(f"('{k}', '{c}', '{o}')" for k, (c, o) in QA.ISSUES.items())


@query("issue_taxonomy", f"WITH d(issue_type, issue_code, object_type) AS (VALUES {_ISSUE_ROWS}) SELECT o_orderkey, o.issue_type, issue_code, object_type FROM (SELECT o_orderkey, {list(QA.ISSUES)}[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS issue_type FROM orders) o JOIN d USING (issue_type)")
def _(v):
    kind = F.element_at(F.array(*[F.lit(k) for k in QA.ISSUES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return QA.with_issue_code(v.orders.select("o_orderkey", kind.alias("issue_type")))


@query("junction_conflict_groups", """WITH t AS (SELECT DISTINCT a.junction_id AS a, b.junction_id AS b FROM junction_hits a JOIN junction_hits b USING (surface_id)), r(j, o) AS (SELECT a, a FROM t UNION SELECT r.j, t.b FROM r JOIN t ON t.a = r.o), g AS (SELECT j, min(o) AS g FROM r GROUP BY j)
    SELECT j AS junction_id, g AS group_id FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)""")
def _(v):
    return QA.junction_conflict_groups(junction_hits(v))
