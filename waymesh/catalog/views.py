"""Road-network shaped views over the driver's parquet tables, in Spark and in SQL.

Keys in the tables start at 0 while id 0 means "no junction" in a road network, so every id
is shifted by one. Positions are laid out in tiles of about 1 km with 2 000 objects each, so the
density of objects stays the same however large the tables are.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPREAD_ROWS = 100_000
# A task sorts and groups several times the bytes that it reads, so shuffles of larger tables are cut finer.
TASK_BYTES, ROWS_A_TASK = 16 << 20, 200_000
INITIAL_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

KIND_2_VALUES = (1, 4, 8, 16, 64, 128, 2048)


def tile_x(id_: Column) -> Column:
    return ((id_ * 7919) % 1009 + 1009 * F.floor(id_ / 2000)).cast("double")


def tile_y(id_: Column) -> Column:
    return ((id_ * 104729) % 1013).cast("double")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


class Views:
    """Lazy access to the parquet tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._measured: set[str] = set()
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
        spark.conf.set(INITIAL_PARTS, spark.conf.get("spark.sql.shuffle.partitions"))

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self._measured:
            self._measured.add(name)
            self.spark.conf.set(INITIAL_PARTS, max(int(self.spark.conf.get(INITIAL_PARTS)), df.count() // ROWS_A_TASK))
        if name == "events":
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                  "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
        if name in tables:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def n_customer(self) -> int:
        return self.table("customer").count()

    @cached_property
    def n_part(self) -> int:
        return self.table("part").count()

    @cached_property
    def net_nodes(self) -> DataFrame:
        id_ = F.col("c_custkey") + 1
        kind = F.element_at(F.array(*[F.lit(k) for k in KIND_2_VALUES]), F.col("c_nationkey") % 7 + 1)
        return self.customer.select(
            id_.alias("id"),
            F.when(id_ % 5 == 0, id_ - 1).alias("mainnodeid"),
            tile_x(id_).alias("x"), tile_y(id_).alias("y"),
            kind.alias("kind_2"),
            (id_ % 3 + 1).cast("int").alias("grade_2"),
            (id_ % 4).cast("int").alias("closed_con"),
        )

    @cached_property
    def net_chain_roads(self) -> DataFrame:
        id_ = F.col("c_custkey") + 1
        return self.customer.where((id_ % 8 != 0) & (id_ < self.n_customer)).select(
            id_.alias("id"), id_.alias("snodeid"), (id_ + 1).alias("enodeid"),
            (id_ % 17 + 1).alias("length_m"),
            (id_ % 4).cast("int").alias("direction"),
            F.when(id_ % 3 == 0, 128).otherwise(0).alias("formway"),
            F.when(id_ % 5 < 3, 8).otherwise(0).alias("roadtype"),
            F.concat(F.lpad((F.col("c_nationkey") % 4).cast("string"), 2, "0"), F.lit("01")).alias("kind"),
        )

    @cached_property
    def net_roads(self) -> DataFrame:
        o, s = F.col("o_orderkey"), F.col("o_custkey") + 1
        kind = F.concat(
            F.lpad((o % 13).cast("string"), 2, "0"), F.lpad((o % 11).cast("string"), 2, "0"), F.lit("|"),
            F.when(o % 17 == 0, "1217").when(o % 19 == 0, "110a").otherwise(
                F.concat(F.lpad((o % 11).cast("string"), 2, "0"), F.lit("01"))))
        x, y = tile_x(s), tile_y(s)
        return self.orders.select(
            (o + 1).alias("id"), s.alias("snodeid"),
            ((o * 31 + 7) % (self.n_customer + 5) + 1).alias("enodeid"),
            (o % 4).cast("int").alias("direction"),
            F.when(o % 10 == 0, 128).when(o % 10 == 1, 256).when(o % 10 == 2, 1024).otherwise(0).alias("formway"),
            kind.alias("kind"),
            F.array(
                point(x, y), point(x + o % 37 - 18, y + o % 23 - 11),
                point(x + o % 53 - 26, y + o % 41 - 20), point(x + o % 71 - 35, y + o % 67 - 33),
            ).alias("pts"),
        )

    def spread(self, df: DataFrame, key: str = "id") -> DataFrame:
        """Rows dealt by key over all cores, and over more tasks where these would get too many, for steps that cost far more than a shuffle."""
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, df.count() // SPREAD_ROWS), key)

    @cached_property
    def road_points(self) -> DataFrame:
        return self.net_roads.select("id", F.posexplode("pts").alias("pos", "p")).select(
            "id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    @cached_property
    def patch_roads(self) -> DataFrame:
        o = F.col("o_orderkey")
        patches = F.when(o % 7 == 0, F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1)).otherwise(
            F.array(F.col("c_nationkey")))
        return (self.orders.where(o % 9 != 0)
                .join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
                .select((o + 1).alias("road_id"), F.explode(patches).alias("patch_id")))

    @cached_property
    def link_roads(self) -> DataFrame:
        id_ = F.col("p_partkey") + 1
        x, y = tile_x(id_), tile_y(id_)
        return self.part.select(
            id_.alias("id"), id_.alias("snodeid"), (id_ + 1).alias("enodeid"),
            (F.col("p_size") % 4).cast("int").alias("direction"),
            F.array(point(x, y), point(x + id_ % 41 - 15, y + id_ % 29 - 12)).alias("pts"))

    @cached_property
    def lanes(self) -> DataFrame:
        arrow = (F.when(F.col("l_returnflag") == "A", "b").when(F.col("l_returnflag") == "N", "a").otherwise("c"))
        return self.lineitem.select(
            (F.col("l_partkey") + 1).alias("link"), F.col("l_linenumber").alias("seq"),
            F.when(F.col("l_linestatus") == "O", arrow).otherwise(F.concat(arrow, F.lit(",d"))).alias("arrow"),
            (F.col("l_linenumber") % 2 + 2).cast("int").alias("lane_dir"))

    @cached_property
    def conditions(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_linenumber") % 3).cast("int").alias("cond_type"),
            (F.col("l_partkey") + 1).alias("in_link"), (F.col("l_suppkey") + 1).alias("out_link"),
            F.col("l_orderkey").alias("memo"))

    @cached_property
    def relations(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_partkey") + 1).alias("target_id"), (F.col("l_suppkey") + 1).alias("base_id"),
            F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("status")).distinct()

    @cached_property
    def track_points(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("traj"), F.col("event_id").alias("seq"),
            F.unix_micros("ts").alias("ts_us"), F.col("value").alias("x"))

    @cached_property
    def seg_nodes(self) -> DataFrame:
        """Segment, end flag and the junctions it needs; built from orders, at most four rows each."""
        o = F.col("o_orderkey")
        n = self.n_part
        nodes = F.array(
            F.struct(F.lit(0).alias("pos"), F.lit("pair").alias("role"), (o * 3 % n + 1).alias("node_id")),
            F.struct(F.lit(1).alias("pos"), F.lit("pair").alias("role"), (o * 5 % n + 2).alias("node_id")),
            F.struct(F.lit(2).alias("pos"), F.lit("junc").alias("role"), (o * 7 % n + 1).alias("node_id")),
            F.struct(F.lit(3).alias("pos"), F.lit("junc").alias("role"), (o * 11 % n + 1).alias("node_id")))
        return self.orders.select((o + 1).alias("segment_id"), F.explode(F.slice(nodes, 1, (o % 3 + 2).cast("int"))).alias("n")).select(
            "segment_id", "n.pos", "n.role", "n.node_id")

    @cached_property
    def surfaces(self) -> DataFrame:
        """Axis-parallel junction surfaces around every tenth customer."""
        id_ = F.col("c_custkey") + 1
        half = id_ % 20 + 15
        x, y = tile_x(id_), tile_y(id_)
        return self.customer.where(id_ % 10 == 0).select(
            id_.alias("surface_id"), (id_ % 4).cast("int").alias("source_no"),
            (x - half).alias("x0"), (y - half).alias("y0"), (x + half).alias("x1"), (y + half).alias("y1"),
            F.array(point(x - half, y - half), point(x + half, y - half), point(x + half, y + half),
                    point(x - half, y + half), point(x - half, y - half)).alias("ring"))

    @cached_property
    def scored(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id").select(
            "doc_id", "lang", "source", "n_chars", "quality", "toxic",
            ((F.col("doc_id") * 7919) % 1000 / 1000.0).cast("double").alias("score"))

    @cached_property
    def sequences(self) -> DataFrame:
        return self.conversations.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


_X = "CAST(({0} * 7919) % 1009 + 1009 * ({0} // 2000) AS DOUBLE)"
_Y = "CAST(({0} * 104729) % 1013 AS DOUBLE)"
_CX, _CY = _X.format("(c_custkey + 1)"), _Y.format("(c_custkey + 1)")
_OX, _OY = _X.format("(o_custkey + 1)"), _Y.format("(o_custkey + 1)")
_PX, _PY = _X.format("(p_partkey + 1)"), _Y.format("(p_partkey + 1)")

VIEW_SQL = {
    "net_nodes": f"""SELECT c_custkey + 1 AS id, CASE WHEN (c_custkey + 1) % 5 = 0 THEN c_custkey END AS mainnodeid,
        {_CX} AS x, {_CY} AS y,
        CAST([1, 4, 8, 16, 64, 128, 2048][c_nationkey % 7 + 1] AS INTEGER) AS kind_2,
        CAST((c_custkey + 1) % 3 + 1 AS INTEGER) AS grade_2, CAST((c_custkey + 1) % 4 AS INTEGER) AS closed_con
        FROM customer""",
    "net_chain_roads": """SELECT c_custkey + 1 AS id, c_custkey + 1 AS snodeid, c_custkey + 2 AS enodeid,
        (c_custkey + 1) % 17 + 1 AS length_m, CAST((c_custkey + 1) % 4 AS INTEGER) AS direction,
        CASE WHEN (c_custkey + 1) % 3 = 0 THEN 128 ELSE 0 END AS formway,
        CASE WHEN (c_custkey + 1) % 5 < 3 THEN 8 ELSE 0 END AS roadtype,
        lpad(CAST(c_nationkey % 4 AS VARCHAR), 2, '0') || '01' AS kind
        FROM customer WHERE (c_custkey + 1) % 8 <> 0 AND c_custkey + 1 < (SELECT count(*) FROM customer)""",
    "net_roads": f"""SELECT o_orderkey + 1 AS id, o_custkey + 1 AS snodeid,
        (o_orderkey * 31 + 7) % ((SELECT count(*) FROM customer) + 5) + 1 AS enodeid,
        CAST(o_orderkey % 4 AS INTEGER) AS direction,
        CASE o_orderkey % 10 WHEN 0 THEN 128 WHEN 1 THEN 256 WHEN 2 THEN 1024 ELSE 0 END AS formway,
        lpad(CAST(o_orderkey % 13 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 11 AS VARCHAR), 2, '0') || '|' ||
        CASE WHEN o_orderkey % 17 = 0 THEN '1217' WHEN o_orderkey % 19 = 0 THEN '110a'
        ELSE lpad(CAST(o_orderkey % 11 AS VARCHAR), 2, '0') || '01' END AS kind,
        [{_OX}, {_OX} + o_orderkey % 37 - 18, {_OX} + o_orderkey % 53 - 26, {_OX} + o_orderkey % 71 - 35] AS xs,
        [{_OY}, {_OY} + o_orderkey % 23 - 11, {_OY} + o_orderkey % 41 - 20, {_OY} + o_orderkey % 67 - 33] AS ys
        FROM orders""",
    "road_points": """SELECT id, CAST(i - 1 AS INTEGER) AS pos, xs[i] AS x, ys[i] AS y
        FROM net_roads, (SELECT unnest([1, 2, 3, 4]) AS i)""",
    "patch_roads": """SELECT o_orderkey + 1 AS road_id, c_nationkey AS patch_id FROM orders
        JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 9 <> 0
        UNION ALL SELECT o_orderkey + 1, c_nationkey + 1 FROM orders
        JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 9 <> 0 AND o_orderkey % 7 = 0""",
    "link_roads": f"""SELECT p_partkey + 1 AS id, p_partkey + 1 AS snodeid, p_partkey + 2 AS enodeid,
        CAST(p_size % 4 AS INTEGER) AS direction, {_PX} AS x0, {_PY} AS y0,
        {_PX} + (p_partkey + 1) % 41 - 15 AS x1, {_PY} + (p_partkey + 1) % 29 - 12 AS y1 FROM part""",
    "lanes": """SELECT l_partkey + 1 AS link, l_linenumber AS seq,
        CASE l_returnflag WHEN 'A' THEN 'b' WHEN 'N' THEN 'a' ELSE 'c' END ||
        CASE WHEN l_linestatus = 'O' THEN '' ELSE ',d' END AS arrow,
        CAST(l_linenumber % 2 + 2 AS INTEGER) AS lane_dir FROM lineitem""",
    "conditions": """SELECT CAST(l_linenumber % 3 AS INTEGER) AS cond_type, l_partkey + 1 AS in_link,
        l_suppkey + 1 AS out_link, l_orderkey AS memo FROM lineitem""",
    "relations": """SELECT DISTINCT l_partkey + 1 AS target_id, l_suppkey + 1 AS base_id,
        CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS status FROM lineitem""",
    "track_points": "SELECT user_id AS traj, event_id AS seq, epoch_us(ts) AS ts_us, value AS x FROM events",
    "seg_nodes": """SELECT o_orderkey + 1 AS segment_id, p.pos, p.role,
        o_orderkey * p.m % (SELECT count(*) FROM part) + p.a AS node_id FROM orders,
        (VALUES (0, 'pair', 3, 1), (1, 'pair', 5, 2), (2, 'junc', 7, 1), (3, 'junc', 11, 1)) AS p(pos, role, m, a)
        WHERE p.pos < o_orderkey % 3 + 2""",
    "surfaces": f"""SELECT c_custkey + 1 AS surface_id, CAST((c_custkey + 1) % 4 AS INTEGER) AS source_no,
        {_CX} - ((c_custkey + 1) % 20 + 15) AS x0, {_CY} - ((c_custkey + 1) % 20 + 15) AS y0,
        {_CX} + ((c_custkey + 1) % 20 + 15) AS x1, {_CY} + ((c_custkey + 1) % 20 + 15) AS y1
        FROM customer WHERE (c_custkey + 1) % 10 = 0""",
    "scored": """SELECT d.doc_id, lang, source, n_chars, quality, toxic,
        CAST((d.doc_id * 7919) % 1000 / 1000.0 AS DOUBLE) AS score FROM documents d JOIN labels USING (doc_id)""",
    "sequences": "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations",
}
