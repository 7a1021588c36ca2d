"""Label tables and measures."""
from pyspark.sql import functions as F

from ..plans import scores as SC
from .registry import query


@query("label_weights", """WITH d AS (SELECT l_partkey AS content, l_suppkey AS object_id, max(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.2 END::DOUBLE) AS w FROM lineitem GROUP BY ALL)
    SELECT object_id, content, round(w / count(*) OVER (PARTITION BY content), 9) AS weight FROM d""")
def _(v):
    tier = F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "N", "rule").otherwise("weak")
    rows = SC.label_weights(v.lineitem.select(F.col("l_suppkey").alias("object_id"), F.col("l_partkey").alias("content"), tier.alias("tier")))
    return rows.withColumn("weight", F.round("weight", 9))


@query("label_scope_mask", "SELECT o_orderkey AS object_id, CASE WHEN o_orderkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) OR o_orderstatus = 'P' THEN 'context_only' ELSE 'eligible' END AS scope FROM orders")
def _(v):
    frozen = v.lineitem.where("l_linenumber = 7").select(F.col("l_partkey").alias("object_id"))
    return SC.label_scope(v.orders.select(F.col("o_orderkey").alias("object_id"), (F.col("o_orderstatus") != "P").alias("in_scope")), frozen)


@query("grouped_folds", "SELECT fold, count(*) AS n, count(DISTINCT o_custkey) AS cases FROM (SELECT o_custkey, CAST(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders) GROUP BY fold")
def _(v):
    rows = SC.grouped_folds(v.orders.select(F.col("o_custkey").alias("case_id")), 5)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


@query("graph_edit_diff", """WITH o AS (SELECT id, direction AS v FROM net_roads WHERE id % 7 <> 0), n AS (SELECT id AS new_id, id AS parent_id, CASE WHEN id % 4 = 0 THEN 9 ELSE direction END AS v FROM net_roads WHERE id % 5 <> 0 UNION ALL SELECT id + 1000000, id, direction FROM net_roads WHERE id % 11 = 0),
    c AS (SELECT parent_id, count(*) AS n FROM n GROUP BY 1) SELECT o.id, n.new_id, CASE WHEN new_id IS NULL THEN 'DROP' WHEN o.id IS NULL THEN 'CREATE' WHEN c.n > 1 THEN 'SPLIT' WHEN o.v = n.v THEN 'COPY' ELSE 'UPDATE' END AS op FROM o FULL JOIN n ON n.parent_id = o.id LEFT JOIN c ON c.parent_id = n.parent_id""")
def _(v):
    i, d = F.col("id"), F.col("direction")
    new = v.net_roads.where("id % 5 != 0").select("id", i.alias("parent_id"), F.when(i % 4 == 0, 9).otherwise(d).alias("value")).unionAll(
        v.net_roads.where("id % 11 = 0").select(i + 1000000, i, d))
    return SC.graph_edit(v.net_roads.where("id % 7 != 0").select("id", d.alias("value")), new)


@query("candidate_set_build", "SELECT l_partkey AS content, min(l_orderkey) AS candidate_id, count(*) AS copies, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources FROM lineitem GROUP BY 1")
def _(v):
    return SC.candidate_sets(v.lineitem.select(F.col("l_partkey").alias("content"), F.col("l_orderkey").alias("candidate_id"), F.col("l_returnflag").alias("source")))


@query("feature_tokens", "SELECT p_partkey, 'size:' || CAST(p_size // 10 AS VARCHAR) || '|type:' || p_type || '|brand:' || p_brand AS tokens FROM part")
def _(v):
    bucket = F.floor(F.col("p_size") / 10).cast("string")
    return v.part.select("p_partkey", F.concat_ws("|", F.concat(F.lit("size:"), bucket), F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("brand:"), "p_brand")).alias("tokens"))


@query("forbidden_feature_check", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)")
def _(v):
    banned = v.nation.where("n_regionkey = 1").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("p_brand"))
    return v.part.select("p_partkey", "p_brand").join(banned, "p_brand", "left_semi").select("p_partkey", "p_brand")


@query("softmax_confidence", "WITH m AS (SELECT doc_id, source, exp(score - max(score) OVER (PARTITION BY source)) AS e FROM scored) SELECT doc_id, round(e / sum(e) OVER (PARTITION BY source), 9) AS confidence FROM m")
def _(v):
    return SC.softmax_share(v.scored, "source").select("doc_id", F.round("confidence", 9).alias("confidence"))


@query("zero_error_threshold", "SELECT coalesce(min(CASE WHEN quality = 1 AND toxic = 1 THEN score END), 0.0::DOUBLE) AS threshold FROM scored")
def _(v):
    return SC.zero_error_threshold(v.scored.select("score", (F.col("quality") == 1).alias("eligible"), (F.col("toxic") == 1).alias("unsafe")))


@query("confusion_metrics", """WITH r AS (SELECT l_returnflag AS t, CASE WHEN l_linenumber % 5 = 0 THEN 'A' WHEN l_linenumber % 5 = 1 THEN 'N' ELSE l_returnflag END AS p FROM lineitem), a AS (SELECT t AS op, count(*) AS support, CAST(count_if(t = p) AS BIGINT) AS hits FROM r GROUP BY 1), b AS (SELECT p AS op, count(*) AS predicted FROM r GROUP BY 1)
    SELECT op, support, predicted, hits, round(hits / predicted, 6) AS precision, round(hits / support, 6) AS recall, round(2 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support), 6) AS f1 FROM a JOIN b USING (op)""")
def _(v):
    n, f = F.col("l_linenumber"), F.col("l_returnflag")
    return SC.confusion_metrics(v.lineitem.select(f.alias("truth"), F.when(n % 5 == 0, "A").when(n % 5 == 1, "N").otherwise(f).alias("predicted")))
