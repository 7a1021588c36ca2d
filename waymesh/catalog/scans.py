"""Sources and sinks."""
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import rounded
from ..operators.profiles import profile, update_by_id
from ..sources import readers as R
from ..sources import sinks as W
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["spots"] = """SELECT event_id, user_id, s, (event_id * 7 + s * 13) % 400 - 200 AS lon, (event_id * 11 + s * 17) % 200 - 100 AS lat,
    (event_id + s) % 3 AS rec FROM events, (SELECT unnest([0, 1, 2]) AS s)"""


def payload_text(v):
    e = F.col("event_id")

    def spot(s):
        return F.struct(
            F.concat(e, F.lit("-"), F.lit(s)).alias("id"), F.lit("stop").alias("name"),
            ((e * 7 + s * 13) % 400 - 200).cast("string").alias("lon"), ((e * 11 + s * 17) % 200 - 100).cast("string").alias("lat"),
            ((e + s) % 3).alias("isRecommend"), F.col("event_type").alias("type"))

    data = F.struct(F.struct(F.col("user_id").cast("string").alias("id")).alias("location"), F.array(spot(0), spot(1), spot(2)).alias("list"))
    text = F.to_json(F.struct(e.cast("string").alias("tid"), F.col("user_id").cast("string").alias("gd_id"), data.alias("data")))
    return v.events.select(F.when(e % 50 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


@query("scan_geojson", "SELECT CAST(id AS VARCHAR) AS id, kind, len(xs) AS points, xs[1] AS first_x, ys[4] AS last_y FROM net_roads")
def _(v):
    text = v.net_roads.select(W.geojson_line(["id", "kind"], F.col("pts")).alias("value"))
    rows = R.features_from_text(text, "value")
    return rows.select(F.col("properties")["id"].alias("id"), F.col("properties")["kind"].alias("kind"),
                       F.size("pts").cast("bigint").alias("points"), F.col("pts")[0]["x"].alias("first_x"),
                       F.element_at("pts", -1)["y"].alias("last_y"))


@query("scan_ndjson_points", """SELECT CAST(event_id % 50 = 0 AS BOOLEAN) AS is_bad, count(*) AS rows_read,
    coalesce(sum(CASE WHEN event_id % 50 = 0 THEN 0 ELSE 3 END), 0)::BIGINT AS spots FROM events GROUP BY 1""")
def _(v):
    rows = R.payloads_from_text(payload_text(v), "value")
    return rows.groupBy(F.col("_corrupt").isNotNull().alias("is_bad")).agg(
        F.count("*").alias("rows_read"), F.coalesce(F.sum(F.size("data.list")), F.lit(0)).cast("bigint").alias("spots"))


@query("explode_recommended_points", """SELECT CAST(event_id AS VARCHAR) || '-' || CAST(s AS VARCHAR) AS spot_id, CAST(user_id AS VARCHAR) AS cen_id,
    CAST(event_id AS VARCHAR) AS req_tid, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM spots
    WHERE event_id % 50 <> 0 AND rec = 1 AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90""")
def _(v):
    rows = R.payloads_from_text(payload_text(v), "value").where(F.col("_corrupt").isNull())
    return R.recommended_points(rows).select("spot_id", "cen_id", "req_tid", "lon", "lat")


@query("scan_csv_rows", "SELECT CAST(c_custkey AS VARCHAR) AS target_id, c_name AS note, c_mktsegment AS status FROM customer")
def _(v):
    text = v.customer.select(F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("line"))
    return text.select(F.from_csv("line", "target_id string, note string, status string").alias("r")).select("r.*")


@query("scan_patch_partitions", """SELECT 'customer' AS layer, count(*) AS row_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def _(v):
    return R.rows_per_source(v.spark, [f"{v.sf_dir}/{t}.parquet" for t in ("customer", "orders", "lineitem")])


@query("scan_bbox_prune", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 5000
    AND l_partkey BETWEEN 20 AND 120""")
def _(v):
    window = (F.col("l_orderkey") >= 100) & (F.col("l_orderkey") < 5000) & F.col("l_partkey").between(20, 120)
    return v.lineitem.where(window).select("l_orderkey", "l_linenumber", "l_partkey")


@query("sink_partitioned", "SELECT direction, count(*) AS roads, min(id) AS first_id FROM net_roads WHERE direction <> 1 GROUP BY direction")
def _(v):
    path = W.scratch_path(v.spark, "roads")
    W.write_partitioned(v.net_roads, path, "direction", ["snodeid"], files_per_partition=4)
    written = v.spark.read.parquet(path).where(F.col("direction") != 1)
    return written.groupBy("direction").agg(F.count("*").alias("roads"), F.min("id").alias("first_id"))


@query("sink_geojson_lines", "SELECT id, list_max(xs) AS maxx FROM net_roads")
def _(v):
    path = W.scratch_path(v.spark, "features")
    W.write_geojson_lines(v.net_roads, path, ["id"])
    rows = R.read_geojson(v.spark, path, one_feature_per_line=True)
    return rows.select(F.col("properties")["id"].cast("bigint").alias("id"), G.bounds(F.col("pts"))["maxx"].alias("maxx"))


_PROFILE = """count(*) AS row_count, CAST(count_if(kind IS NULL) AS BIGINT) AS missing_kind, 0::BIGINT AS invalid_geometry, min(list_min(xs)) AS minx,
    min(list_min(ys)) AS miny, max(list_max(xs)) AS maxx, max(list_max(ys)) AS maxy FROM net_roads"""


@query("layer_profile", f"SELECT {_PROFILE}")
def _(v):
    return profile(v.net_roads, [], ["kind"]).drop("content_sum")


@query("layer_profile_by_patch", f"SELECT direction, {_PROFILE} GROUP BY direction")
def _(v):
    return profile(v.net_roads, ["direction"], ["kind"]).drop("content_sum")


@query("attribute_update_by_id", """SELECT n.id, CASE WHEN t.id IS NOT NULL THEN 64 ELSE kind_2 END AS kind_2 FROM net_nodes n
    LEFT JOIN (SELECT s_suppkey * 3 + 1 AS id FROM supplier) t ON t.id = n.id""")
def _(v):
    updates = v.supplier.select((F.col("s_suppkey") * 3 + 1).alias("id"), F.lit(64).alias("kind_2"))
    return update_by_id(v.net_nodes.select("id", "kind_2"), updates, "id", "kind_2")


@query("reproject_web_mercator", """SELECT id, round(6378137.0 * radians(id % 3600 / 10.0 - 180), 4) AS x,
    round(6378137.0 * ln(tan(pi() / 4 + radians(id % 1600 / 10.0 - 80) / 2)), 4) AS y FROM net_nodes""")
def _(v):
    xy = G.mercator(F.col("id") % 3600 / 10.0 - 180, F.col("id") % 1600 / 10.0 - 80)
    return v.net_nodes.select("id", xy.alias("p")).select("id", rounded(F.col("p.x"), 4).alias("x"), rounded(F.col("p.y"), 4).alias("y"))
