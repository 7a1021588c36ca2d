"""Lines and node kinds for the chain network."""
from pyspark.sql import functions as F

from .graphs import chain_edges
from .views import VIEW_SQL, point, tile_x, tile_y

_X = "CAST(({0} * 7919) % 1009 + 1009 * ({0} // 2000) AS DOUBLE)"
_Y = "CAST(({0} * 104729) % 1013 AS DOUBLE)"
VIEW_SQL["chain_lines"] = f"""SELECT *, {_X.format('src')} AS x0, {_Y.format('src')} AS y0, {_X.format('dst')} AS x1, {_Y.format('dst')} AS y1 FROM chain_edges"""
VIEW_SQL["chain_degrees"] = """SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS roads FROM (
    SELECT src AS node, CASE WHEN direction <> 2 THEN 1 ELSE 0 END AS i, CASE WHEN direction <> 3 THEN 1 ELSE 0 END AS o FROM chain_edges UNION ALL
    SELECT dst, CASE WHEN direction <> 3 THEN 1 ELSE 0 END, CASE WHEN direction <> 2 THEN 1 ELSE 0 END FROM chain_edges) GROUP BY node"""


def chain_lines(v):
    pts = F.array(point(tile_x(F.col("src")), tile_y(F.col("src"))), point(tile_x(F.col("dst")), tile_y(F.col("dst"))))
    return chain_edges(v).withColumns({"id": F.col("road_id"), "pts": pts})
