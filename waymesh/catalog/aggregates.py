"""Aggregations."""
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import quantiles as Q
from .joins import canon_roads, relation_last
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["degrees"] = """SELECT junction_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
    SELECT src AS junction_id, CASE WHEN direction <> 2 THEN 1 ELSE 0 END AS i, CASE WHEN direction <> 3 THEN 1 ELSE 0 END AS o FROM canon_roads
    UNION ALL SELECT dst, CASE WHEN direction <> 3 THEN 1 ELSE 0 END, CASE WHEN direction <> 2 THEN 1 ELSE 0 END FROM canon_roads) GROUP BY junction_id"""
VIEW_SQL["cardinality"] = """SELECT 'one_target_to_many_base' AS error_type, p.target_id, p.base_id, t.bases AS n FROM rel_pairs p JOIN
    (SELECT target_id, count(*) AS bases FROM rel_pairs GROUP BY 1 HAVING count(*) > 1) t USING (target_id)
    UNION ALL SELECT 'many_target_to_one_base', p.target_id, p.base_id, b.targets FROM rel_pairs p JOIN
    (SELECT base_id, count(*) AS targets FROM rel_pairs GROUP BY 1 HAVING count(*) > 1) b USING (base_id)
    UNION ALL SELECT 'duplicate_target_rows', target_id, NULL, CAST(sum(n) AS BIGINT) FROM rel_pairs GROUP BY target_id HAVING sum(n) > 1"""
VIEW_SQL["rel_pairs"] = "SELECT target_id, base_id, count(*) AS n FROM relations WHERE status = 0 AND base_id > 0 GROUP BY ALL"
VIEW_SQL["source_surfaces"] = """SELECT s.surface_id, surface_id - surface_id % 20 AS mainnodeid, (surface_id // 10) % 7 AS patch_id, n.kind_2,
    ['T03', 'T04', 'T02_INPUT'][CAST(surface_id // 10 % 3 + 1 AS INTEGER)] AS source,
    s.x0 + dx AS x0, s.x1 + dx AS x1, s.y0 AS y0, s.y1 AS y1 FROM (SELECT surface_id, CAST(m % 1000 AS DOUBLE) AS x0, CAST(m % 1000 + 10 AS DOUBLE) AS x1,
    CAST(m % 700 AS DOUBLE) AS y0, CAST(m % 700 + 10 AS DOUBLE) AS y1, CASE WHEN surface_id % 20 = 10 THEN m % 25 ELSE 0 END AS dx
    FROM (SELECT surface_id, surface_id // 20 * 37 AS m FROM surfaces)) s JOIN net_nodes n ON n.id = s.surface_id"""


def cardinality(v):
    return A.cardinality_errors(v.relations)


def source_surfaces(v):
    m = F.floor(F.col("surface_id") / 20) * 37
    dx = F.when(F.col("surface_id") % 20 == 10, m % 25).otherwise(0)
    x0, y0 = (m % 1000 + dx).cast("double"), (m % 700).cast("double")

    def corner(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(corner(x0, y0), corner(x0 + 10, y0), corner(x0 + 10, y0 + 10), corner(x0, y0 + 10), corner(x0, y0))
    no = F.floor(F.col("surface_id") / 10)
    source = F.element_at(F.array(F.lit("T03"), F.lit("T04"), F.lit("T02_INPUT")), (no % 3 + 1).cast("int"))
    kinds = v.net_nodes.select(F.col("id").alias("surface_id"), "kind_2")
    return v.surfaces.select("surface_id").join(kinds, "surface_id").select(
        "surface_id", (F.col("surface_id") - F.col("surface_id") % 20).alias("mainnodeid"), (no % 7).alias("patch_id"),
        "kind_2", source.alias("source"), ring.alias("ring"))


@query("group_semantic_nodes", "SELECT canonical_id, count(*) AS members, min(node_id) AS first_member, count(*) = 1 AS is_single FROM canon GROUP BY 1")
def _(v):
    return A.junction_groups(J.canonical_nodes(v.net_nodes))


@query("group_all_covered", """SELECT canonical_id, bool_and(kind_2 <> 1) AS all_covered, count(*) AS members, CAST(count_if(kind_2 <> 1) AS BIGINT) AS covered_members
    FROM canon JOIN net_nodes ON id = node_id GROUP BY 1""")
def _(v):
    covered = v.net_nodes.where(F.col("kind_2") != 1).select(F.col("id").alias("node_id"))
    return A.covered_groups(J.canonical_nodes(v.net_nodes), covered)


@query("in_out_degree", "SELECT * FROM degrees")
def _(v):
    return A.in_out_degree(canon_roads(v))


@query("incident_degree_filtered", """SELECT junction_id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS junction_id FROM canon_roads
    WHERE formway & 384 = 0 AND src <> dst) GROUP BY 1""")
def _(v):
    return A.incident_degree(canon_roads(v), 128 | 256)


@query("arrow_concat", """SELECT link, lane_dir, string_agg(arrow, ',' ORDER BY seq, arrow) AS arrows, count(*) = count(DISTINCT seq) AND min(seq) = 1 AND max(seq) = count(*)
    AND count(*) = count(DISTINCT (seq, arrow)) AS sequence_complete FROM lanes JOIN link_roads ON id = link GROUP BY link, lane_dir""")
def _(v):
    from ..plans.preprocess import lane_groups
    return lane_groups(v.lanes, v.link_roads).select("link", "lane_dir", "arrows", "sequence_complete")


@query("relation_cardinality", "SELECT * FROM cardinality")
def _(v):
    return cardinality(v)


@query("cardinality_suppress", """SELECT * FROM relations WHERE target_id NOT IN (SELECT target_id FROM cardinality
    WHERE error_type IN ('one_target_to_many_base', 'duplicate_target_rows'))""")
def _(v):
    return A.without_blocked_targets(v.relations, cardinality(v))


@query("reason_counts", "SELECT error_type, count(*) AS n, count(DISTINCT target_id) AS targets FROM cardinality GROUP BY 1")
def _(v):
    return cardinality(v).groupBy("error_type").agg(F.count("*").alias("n"), F.count_distinct("target_id").alias("targets"))


VIEW_SQL["junction_states"] = """SELECT n.id, n.kind_2 IN (4, 8, 16, 64, 128, 2048) AS semantic, n.grade_2 <> 3 AS has_evidence, r.status, d.junction_id IS NOT NULL AS consumable,
    ['T07', 'T03', 'T04'][CAST(n.id % 3 + 1 AS INTEGER)] AS source FROM net_nodes n LEFT JOIN relation_last r ON r.target_id = n.id
    LEFT JOIN degrees d ON d.junction_id = r.base_id"""


def junction_states(v):
    degree = A.in_out_degree(canon_roads(v)).select(F.col("junction_id").alias("base_id"), F.lit(True).alias("_c"))
    source = F.element_at(F.array(F.lit("T07"), F.lit("T03"), F.lit("T04")), (F.col("id") % 3 + 1).cast("int"))
    return (v.net_nodes.join(relation_last(v).withColumnRenamed("target_id", "id"), "id", "left").join(degree, "base_id", "left")
            .select("id", F.col("kind_2").isin(4, 8, 16, 64, 128, 2048).alias("semantic"), (F.col("grade_2") != 3).alias("has_evidence"),
                    "status", F.coalesce("_c", F.lit(False)).alias("consumable"), source.alias("source")))


@query("funnel_top_level", """SELECT count(*) AS semantic_total, CAST(count_if(has_evidence) AS BIGINT) AS evidence_total, count(status) AS published_total,
    CAST(count_if(status = 0) AS BIGINT) AS success_total, CAST(count_if(status = 1) AS BIGINT) AS failure_total, CAST(count_if(status = 0 AND consumable) AS BIGINT)
    AS consumable_total, CAST(count_if(status = 0 AND NOT consumable) AS BIGINT) AS unconsumable_total FROM junction_states WHERE semantic""")
def _(v):
    from ..plans.anchor import funnel
    return funnel(junction_states(v))


@query("funnel_by_source", """SELECT source, count(*) AS semantic_total, CAST(count_if(has_evidence) AS BIGINT) AS evidence_total, count(status) AS published_total,
    CAST(count_if(status = 0) AS BIGINT) AS success_total, CAST(count_if(status = 1) AS BIGINT) AS failure_total, CAST(count_if(status = 0 AND consumable) AS BIGINT)
    AS consumable_total, CAST(count_if(status = 0 AND NOT consumable) AS BIGINT) AS unconsumable_total FROM junction_states WHERE semantic GROUP BY source""")
def _(v):
    from ..plans.anchor import funnel
    return funnel(junction_states(v), "source")


@query("length_share_by_class", """WITH t AS (SELECT CAST(sum(length_m) AS DOUBLE) AS a, CAST(sum(CASE WHEN formway = 128 THEN length_m ELSE 0 END) AS DOUBLE) AS s FROM net_chain_roads),
    c AS (SELECT 'direction' AS class_name, CAST(direction AS VARCHAR) AS class_value, length_m, formway FROM net_chain_roads UNION ALL
    SELECT 'formway', CAST(formway AS VARCHAR), length_m, formway FROM net_chain_roads UNION ALL SELECT 'kind', kind, length_m, formway FROM net_chain_roads
    UNION ALL SELECT 'roadtype', CAST(roadtype AS VARCHAR), length_m, formway FROM net_chain_roads)
    SELECT class_name, class_value, count(*) AS n, CAST(sum(length_m) AS BIGINT) AS length_m, round(sum(length_m) / any_value(a), 6) AS share,
    round(sum(CASE WHEN formway = 128 THEN length_m ELSE 0 END) / any_value(s), 6) AS subset_share FROM c, t GROUP BY 1, 2""")
def _(v):
    return A.share_by_class(v.net_chain_roads, ["direction", "formway", "kind", "roadtype"], "length_m", F.col("formway") == 128)


@query("segment_aggregate", """SELECT id // 4 AS segment_id, count(*) AS roads, CAST(sum(formway) AS BIGINT) AS formway_sum, min(CASE WHEN kind < '0500' THEN 0 ELSE 1 END) AS best_rank,
    count(DISTINCT direction) AS directions, count(DISTINCT substr(kind, 1, 2)) > 1 AS grade_conflict FROM net_roads GROUP BY 1""")
def _(v):
    from ..plans.segment import segment_summary
    roads = v.net_roads.withColumn("segment_id", F.floor(F.col("id") / 4)).withColumn("grade", F.substring("kind", 1, 2))
    return segment_summary(roads.withColumn("rank", F.when(F.col("kind") < "0500", 0).otherwise(1))).select(
        "segment_id", "roads", "formway_sum", "best_rank", "directions", "grade_conflict")


@query("mixed_value_check", "SELECT c_nationkey, min(c_mktsegment) <> max(c_mktsegment) AS mixed FROM customer GROUP BY 1")
def _(v):
    return v.customer.groupBy("c_nationkey").agg((F.min("c_mktsegment") != F.max("c_mktsegment")).alias("mixed"))


@query("surface_fusion", """WITH o AS (SELECT *, list_position(['T03', 'T04', 'T02_INPUT'], source) * 1000000000::BIGINT + surface_id AS r FROM source_surfaces),
    g AS (SELECT mainnodeid, count(*) AS surface_count, count(DISTINCT source) AS sources, arg_min(kind_2, r) AS k, min(CASE WHEN source = 'T03' THEN surface_id END) AS t03,
    min(CASE WHEN source = 'T04' THEN surface_id END) AS t04, arg_min(surface_id, r) AS f, min(kind_2) <> max(kind_2) AS kc, min(patch_id) <> max(patch_id) AS pc,
    greatest(max(x0) - min(x1), max(y0) - min(y1)) AS gap FROM o GROUP BY 1)
    SELECT mainnodeid, surface_count, CASE WHEN t03 IS NOT NULL AND t04 IS NOT NULL AND k IN (4, 2048) THEN t03 WHEN t03 IS NOT NULL AND t04 IS NOT NULL AND k IN (8, 16, 128)
    THEN t04 ELSE f END AS primary_id, CASE WHEN sources = 1 THEN 'single_source' WHEN gap <= 2 THEN 'union' ELSE 'primary_only' END AS action,
    concat_ws('|', CASE WHEN t03 IS NOT NULL AND t04 IS NOT NULL THEN 't03_t04_same_mainnodeid' END, CASE WHEN kc THEN 'kind_2_conflict' END,
    CASE WHEN pc THEN 'patch_id_conflict' END) AS reasons FROM g""")
def _(v):
    from ..plans.fusion import fuse_surfaces
    return fuse_surfaces(source_surfaces(v)).drop("cells")


@query("quantile_stats", """SELECT user_id, count(value) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90,
    round(quantile_cont(value, 0.1), 4) AS p10, max(value) AS max_value FROM events GROUP BY 1""")
def _(v):
    stats = Q.exact_quantiles(v.events, "user_id", "value", {"p50": 0.5, "p90": 0.9, "p10": 0.1}, 50.0)
    return stats.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p10")], "max_value")


@query("weighted_median", """WITH s AS (SELECT l_suppkey, l_partkey % 200 AS v, CAST(sum(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS u, sum(w) OVER (PARTITION BY l_suppkey) / 2.0 AS h FROM s)
    SELECT l_suppkey, (min(CASE WHEN u >= h THEN v END) + coalesce(min(CASE WHEN u > h THEN v END), min(CASE WHEN u >= h THEN v END))) / 2.0 AS weighted_median FROM c GROUP BY 1""")
def _(v):
    rows = v.lineitem.select("l_suppkey", (F.col("l_partkey") % 200).alias("v"), F.col("l_linenumber").alias("w"))
    return Q.weighted_median(rows, "l_suppkey", "v", "w", 20.0).select("l_suppkey", F.col("weighted_median").cast("double").alias("weighted_median"))


@query("voted_dominant", """SELECT l_partkey, l_suppkey, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_suppkey) AS rn FROM
    (SELECT l_partkey, l_suppkey, count(*) AS votes FROM lineitem GROUP BY ALL)) WHERE rn = 1""")
def _(v):
    return A.dominant_value(v.lineitem, "l_partkey", "l_suppkey")


@query("coverage_by_task", """SELECT lang, CAST(count_if(quality = 1) AS BIGINT) AS quality_yes, CAST(count_if(toxic = 1) AS BIGINT) AS toxic_yes,
    count(doc_id) AS labelled FROM scored GROUP BY lang""")
def _(v):
    from ..plans.scoring import coverage_by_task
    return coverage_by_task(v.scored, "lang", {"quality_yes": F.col("quality") == 1, "toxic_yes": F.col("toxic") == 1})


@query("bucket_counts", """SELECT CASE WHEN n_chars < 500 THEN '0-500' WHEN n_chars < 2000 THEN '500-2000' ELSE '2000+' END AS bucket, count(*) AS n FROM documents GROUP BY 1""")
def _(v):
    bucket = F.when(F.col("n_chars") < 500, "0-500").when(F.col("n_chars") < 2000, "500-2000").otherwise("2000+")
    return v.documents.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("multiset_f1", """WITH a AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL),
    b AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL),
    c AS (SELECT CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS predicted, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS truth, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS matched
    FROM a FULL JOIN b USING (p, s)) SELECT *, round(matched / predicted, 6) AS precision, round(matched / truth, 6) AS recall,
    round(2 * (matched / predicted) * (matched / truth) / (matched / predicted + matched / truth), 6) AS f1 FROM c""")
def _(v):
    return A.multiset_f1(v.lineitem.where(F.col("l_linenumber") < 6), v.lineitem.where(F.col("l_linenumber") > 2), ["l_partkey", "l_suppkey"])
