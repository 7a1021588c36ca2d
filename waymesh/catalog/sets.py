"""Set operations and diffs."""
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins as J
from ..operators.topk import first_per_key
from .joins import relation_last
from .registry import query


def versions(v):
    current = v.net_roads.where(F.col("id") % 6 != 0).select("id", "direction", "formway")
    baseline = v.net_roads.where(F.col("id") % 5 != 0).select(
        "id", F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("direction")).alias("direction"), "formway")
    return current, baseline


_VERSIONS = """c AS (SELECT id, direction, formway FROM net_roads WHERE id % 6 <> 0),
    b AS (SELECT id, CASE WHEN id % 4 = 0 THEN 9 ELSE direction END AS direction, formway FROM net_roads WHERE id % 5 <> 0)"""


@query("union_sources_tagged", """SELECT id, direction, NULL::INTEGER AS formway, 'carrier' AS source FROM link_roads WHERE id % 2 = 0 UNION ALL
    SELECT id, direction, formway, 'source' FROM net_roads WHERE id % 3 <> 0""")
def _(v):
    from ..plans.replace import union_tagged
    return union_tagged(v.net_roads.where(F.col("id") % 3 != 0).select("id", "direction", "formway"),
                        v.link_roads.where(F.col("id") % 2 == 0).select("id", "direction")).select("id", "direction", "formway", "source")


@query("except_replaced", "SELECT id FROM net_roads WHERE id NOT IN (SELECT road_id FROM patch_roads)")
def _(v):
    replaced = v.patch_roads.select(F.col("road_id").alias("id"))
    return v.net_roads.select("id").join(replaced, "id", "left_anti")


@query("row_set_diff", f"""WITH {_VERSIONS} SELECT 'only_in_current' AS side, * FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b) UNION ALL
    SELECT 'only_in_baseline', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c)""")
def _(v):
    from ..plans.compare import row_set_diff
    return row_set_diff(*versions(v))


@query("semantic_hash_match", f"""WITH {_VERSIONS} SELECT 'roads' AS layer, 'FAIL' AS status""")
def _(v):
    from ..plans.compare import layer_hash_status
    current, baseline = versions(v)
    return layer_hash_status(current, baseline, "roads", ["formway"])


@query("dedupe_keep_first", """SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def _(v):
    rows = v.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    firsts = rows.groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    return firsts.select("l_partkey", "l_suppkey", "f.l_orderkey")


@query("intersect_connected", "SELECT snodeid AS id FROM net_roads INTERSECT SELECT enodeid FROM net_chain_roads")
def _(v):
    return v.net_roads.select(F.col("snodeid").alias("id")).intersect(v.net_chain_roads.select("enodeid"))
