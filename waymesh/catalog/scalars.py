"""Column functions over ids and codes written the way road layers write them."""
from pyspark.sql import functions as F

from ..functions import scalar as S
from .registry import query
from .views import VIEW_SQL, Views

VIEW_SQL["raw_ids"] = r"""SELECT o_orderkey + 1 AS id, CAST(o_custkey AS VARCHAR) AS k,
    CASE o_orderkey % 7 WHEN 0 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' ' WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.0'
    WHEN 2 THEN '  ' WHEN 3 THEN '"' || CAST(o_custkey AS VARCHAR) || '"' WHEN 4 THEN 'NULL' WHEN 5 THEN '0'
    ELSE 'N' || CAST(o_custkey AS VARCHAR) END AS raw,
    CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || ',' || CAST(o_orderkey AS VARCHAR)
    WHEN 1 THEN '["' || CAST(o_custkey AS VARCHAR) || '", "7.0"]' WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '|3;3'
    WHEN 3 THEN '[]' WHEN 4 THEN CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey AS VARCHAR)
    ELSE '9\' || CAST(o_custkey AS VARCHAR) END AS list_text FROM orders"""


def raw_ids(v: Views):
    o, k = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    t = o.cast("string")
    return v.orders.select(
        (o + 1).alias("id"), k.alias("k"),
        F.when(o % 7 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(o % 7 == 1, F.concat(k, F.lit(".0")))
        .when(o % 7 == 2, "  ").when(o % 7 == 3, F.concat(F.lit('"'), k, F.lit('"'))).when(o % 7 == 4, "NULL")
        .when(o % 7 == 5, "0").otherwise(F.concat(F.lit("N"), k)).alias("raw"),
        F.when(o % 6 == 0, F.concat_ws(",", k, t)).when(o % 6 == 1, F.concat(F.lit('["'), k, F.lit('", "7.0"]')))
        .when(o % 6 == 2, F.concat(k, F.lit("|3;3"))).when(o % 6 == 3, "[]").when(o % 6 == 4, F.concat_ws(" ", k, t))
        .otherwise(F.concat(F.lit("9\\"), k)).alias("list_text"))


_STRICT = r"""CASE WHEN lower(trim(trim({0}), '"''')) IN ('', 'none', 'null', 'nan', 'na', 'n/a', '[]') THEN NULL
 ELSE regexp_replace(trim(trim({0}), '"'''), '^(-?[0-9]+)\.0+$', '\1') END"""
_NORM = r"regexp_replace(nullif(trim(raw), ''), '^([0-9]+)\.0+$', '\1')"
_LIST = (r"list_filter(list_transform(string_split_regex(trim(trim(list_text), '[](){}'), '[,;|\\\s]+'), lambda t: "
         + _STRICT.format("t") + "), lambda t: t IS NOT NULL)")


@query("normalize_id", f"SELECT id, {_NORM} AS norm, {_STRICT.format('raw')} AS strict_norm FROM raw_ids")
def _(v):
    return raw_ids(v).select("id", S.normalize_id(F.col("raw")).alias("norm"),
                             S.normalize_id_strict(F.col("raw")).alias("strict_norm"))


@query("normalize_mainnodeid", f"SELECT id, nullif({_NORM}, '0') AS mainnodeid FROM raw_ids")
def _(v):
    return raw_ids(v).select("id", S.normalize_mainnodeid(F.col("raw")).alias("mainnodeid"))


@query("parse_id_list", f"""WITH parts AS (SELECT id, i, l[i] AS t FROM (SELECT id, {_LIST} AS l FROM raw_ids),
    (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(l)),
    firsts AS (SELECT id, t, min(i) AS i FROM parts GROUP BY ALL)
    SELECT r.id, coalesce(string_agg(t, ',' ORDER BY i), '') AS ids, count(t) AS n FROM raw_ids r LEFT JOIN firsts f
    ON r.id = f.id GROUP BY r.id""")
def _(v):
    ids = S.parse_id_list(F.col("list_text"))
    return raw_ids(v).select("id", F.array_join(ids, ",").alias("ids"), F.size(ids).cast("bigint").alias("n"))


@query("join_ids", """SELECT id, CASE WHEN snodeid <= enodeid THEN concat_ws('|', snodeid, enodeid, 'N' || id)
    ELSE concat_ws('|', enodeid, snodeid, 'N' || id) END AS joined FROM net_roads""")
def _(v):
    ids = F.array(F.concat(F.lit("N"), F.col("id")), F.col("snodeid").cast("string"), F.col("enodeid").cast("string"))
    return v.net_roads.select("id", S.join_ids(ids, "|").alias("joined"))


@query("numeric_first_sort_key", f"""SELECT id, CASE WHEN TRY_CAST({_NORM} AS BIGINT) IS NULL THEN 1 ELSE 0 END AS is_text,
    coalesce(TRY_CAST({_NORM} AS BIGINT), 0) AS number, {_NORM} AS text FROM raw_ids""")
def _(v):
    key = S.id_sort_key(S.normalize_id(F.col("raw")))
    return raw_ids(v).select("id", key.alias("k")).select("id", "k.is_text", "k.number", "k.text")


@query("casefold_resolve_columns", """SELECT id, coalesce(a, b) AS mainnodeid FROM (SELECT id,
    CASE WHEN id % 2 = 0 THEN k END AS a, CASE WHEN id % 3 = 0 THEN k END AS b FROM raw_ids)""")
def _(v):
    from ..sources.fields import resolve_columns
    split = raw_ids(v).select("id", F.when(F.col("id") % 2 == 0, F.col("k")).alias("MainNodeId"),
                              F.when(F.col("id") % 3 == 0, F.col("k")).alias("MAINNODEID_2"))
    return resolve_columns(split, {"id": ["ID"], "mainnodeid": ["mainNodeID", "mainnodeid_2"]})


@query("field_alias_conflict", """SELECT id, closed_con, conflict FROM (SELECT id,
    coalesce(a, b) AS closed_con, a IS NOT NULL AND b IS NOT NULL AND a <> b AS conflict FROM (SELECT id,
    CASE WHEN id % 4 <> 0 THEN closed_con END AS a, CASE WHEN id % 3 = 0 THEN 1 END AS b FROM net_nodes))""")
def _(v):
    from ..sources.fields import alias_with_conflict
    both = v.net_nodes.select("id", F.when(F.col("id") % 4 != 0, F.col("closed_con")).alias("closed_con"),
                              F.when(F.col("id") % 3 == 0, 1).alias("closed_connect"))
    return alias_with_conflict(both, "closed_con", "closed_connect")


@query("kind_tokens", """WITH t AS (SELECT id, string_split(kind, '|') AS s FROM net_roads)
    SELECT id, CASE WHEN s[1] = s[2] THEN s[1] ELSE s[1] || ',' || s[2] END AS tokens,
    CASE WHEN s[1][1:2] = s[2][1:2] THEN s[1][1:2] ELSE s[1][1:2] || ',' || s[2][1:2] END AS levels FROM t""")
def _(v):
    return v.net_roads.select("id", F.array_join(S.kind_tokens(F.col("kind")), ",").alias("tokens"),
                              F.array_join(S.kind_levels(F.col("kind")), ",").alias("levels"))


@query("kind_levels", """SELECT level, count(*) AS roads FROM (SELECT DISTINCT id, unnest([substr(kind, 1, 2),
    substr(kind, 6, 2)]) AS level FROM net_roads) GROUP BY level""")
def _(v):
    return v.net_roads.select(F.explode(S.kind_levels(F.col("kind"))).alias("level")).groupBy("level").agg(
        F.count("*").alias("roads"))


@query("kind_suffix_flag", """SELECT id, regexp_matches(kind, '17(\\||$)') AS is_event, regexp_matches(kind,
    '0a(\\||$)') AS is_side FROM net_roads""".replace("\\\\", "\\"))
def _(v):
    return v.net_roads.select("id", S.kind_has_suffix(F.col("kind"), "17").alias("is_event"),
                              S.kind_has_suffix(F.col("kind"), "0a").alias("is_side"))


@query("bit_flags", """SELECT id, formway & 128 <> 0 AS advance_right, formway & 256 <> 0 AS advance_left,
    formway & 1024 <> 0 AS uturn FROM net_roads""")
def _(v):
    f = F.col("formway")
    return v.net_roads.select("id", S.has_bit(f, S.ADVANCE_RIGHT_BIT).alias("advance_right"),
                              S.has_bit(f, S.ADVANCE_LEFT_BIT).alias("advance_left"),
                              S.has_bit(f, S.UTURN_BIT).alias("uturn"))


_ARROW_ROWS = ", ".join(f"('{c}', '{'|'.join(t)}')" for c, t in S.ARROW_TOKENS.items())


@query("arrow_decode", f"""WITH codes(code, tokens) AS (VALUES {_ARROW_ROWS})
    SELECT d.doc_id, d.code, c.tokens FROM (SELECT doc_id, substr('9aBcdefghijklmnoprstuvwxyz012345q', CAST(doc_id % 33 + 1
    AS INTEGER), 1) AS code FROM documents) d LEFT JOIN codes c ON lower(d.code) = c.code""")
def _(v):
    codes = F.lit("9aBcdefghijklmnoprstuvwxyz012345q")
    return v.documents.select("doc_id", F.substring(codes, (F.col("doc_id") % 33 + 1).cast("int"), F.lit(1)).alias("code")).select(
        "doc_id", "code", F.array_join(S.arrow_tokens(F.col("code")), "|").alias("tokens"))


@query("lane_dir_orient", """SELECT id, lane_dir, CASE WHEN direction IN (0, 1, 2) THEN lane_dir = 3 ELSE lane_dir = 2 END AS reversed,
    CASE WHEN (direction < 3 AND lane_dir = 3) OR (direction = 3 AND lane_dir = 2) THEN x1 ELSE x0 END AS first_x
    FROM link_roads, (SELECT unnest([2, 3]) AS lane_dir)""")
def _(v):
    from ..functions.geometry import orient
    roads = v.link_roads.withColumn("lane_dir", F.explode(F.array(F.lit(2), F.lit(3))))
    flag = S.lane_reversed(F.col("direction"), F.col("lane_dir"))
    return roads.select("id", "lane_dir", flag.alias("reversed"), orient(F.col("pts"), flag)[0]["x"].alias("first_x"))


@query("road_roles", """SELECT id, CASE WHEN direction IN (0, 1) THEN 'bidirectional'
    WHEN (direction = 2) = (id % 2 = 0) THEN 'outbound' ELSE 'inbound' END AS role FROM net_roads""")
def _(v):
    return v.net_roads.select("id", S.road_role(F.col("direction"), F.col("id") % 2 == 0).alias("role"))


@query("directionality_from_sgrade", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'dual' WHEN 1 THEN 'single'
    WHEN 2 THEN 'dual' WHEN 3 THEN 'single' END AS directionality FROM documents""")
def _(v):
    grade = F.element_at(F.array(*[F.lit(t) for t in ("0-0双", "0-1单", " Two_Way", "oneway ", "x")]),
                         (F.col("doc_id") % 5 + 1).cast("int"))
    return v.documents.select("doc_id", S.directionality(grade).alias("directionality"))


@query("coerce_int_strict", r"""SELECT id, CASE WHEN TRY_CAST(trim(raw) AS DOUBLE) = floor(TRY_CAST(trim(raw) AS DOUBLE))
    THEN CAST(TRY_CAST(trim(raw) AS DOUBLE) AS BIGINT) END AS value FROM raw_ids""")
def _(v):
    return raw_ids(v).select("id", S.coerce_int(F.col("raw")).alias("value"))


@query("timestamp_parse_seconds", """SELECT event_id, CASE event_id % 5
    WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) WHEN 1 THEN CAST(epoch_us(ts) // 1000 AS DOUBLE) / 1000.0
    WHEN 2 THEN CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 WHEN 3 THEN CAST(epoch_us(date_trunc('second', ts)) AS DOUBLE) / 1000000.0
    END AS seconds FROM events""")
def _(v):
    us = F.unix_micros("ts")
    text = (F.when(F.col("event_id") % 5 == 0, F.expr("unix_micros(ts) div 1000000").cast("string"))
            .when(F.col("event_id") % 5 == 1, F.expr("unix_micros(ts) div 1000").cast("string"))
            .when(F.col("event_id") % 5 == 2, us.cast("string"))
            .when(F.col("event_id") % 5 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("n/a"))
    return v.events.select("event_id", S.timestamp_seconds(text).alias("seconds"))


@query("nested_json_get", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    json_extract_string(props, '$.missing') AS missing FROM events""")
def _(v):
    return v.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                           F.get_json_object("props", "$.missing").alias("missing"))


@query("stable_digest_id", """SELECT block, 'advance_right_' || substr(sha1(string_agg(CAST(id AS VARCHAR), chr(31) ORDER BY id)),
    1, 16) AS segment_id FROM (SELECT id, (id - 1) // 8 AS block FROM net_chain_roads) GROUP BY block""")
def _(v):
    blocks = v.net_chain_roads.groupBy(F.floor((F.col("id") - 1) / 8).alias("block")).agg(
        F.collect_list(F.col("id").cast("string")).alias("ids"))
    return blocks.select("block", S.digest_id(F.col("ids"), "advance_right_").alias("segment_id"))


@query("row_content_hash", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment ||
    '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS content_hash FROM customer""")
def _(v):
    columns = ["c_name", "c_custkey", "c_nationkey", "c_mktsegment"]
    return v.customer.select("c_custkey", S.content_hash(columns).alias("content_hash"))


@query("confidence_from_score", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'conflict' WHEN score >= 0.8 AND n_chars % 100 < 55
    THEN 'medium' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'low' ELSE 'reject' END
    AS confidence FROM scored""")
def _(v):
    return v.scored.select("doc_id", S.confidence(F.col("score") * 1000 / 10, F.col("toxic") == 1,
                                                  F.col("n_chars") % 100).alias("confidence"))


@query("safe_ratio", """SELECT l_orderkey % 1000 AS bucket, round(CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber
    ELSE 0 END) > 0 THEN sum(l_linenumber) / CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS DOUBLE) END, 6)
    AS ratio FROM lineitem GROUP BY 1""")
def _(v):
    opened = F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).otherwise(0))
    return v.lineitem.groupBy((F.col("l_orderkey") % 1000).alias("bucket")).agg(
        S.rounded(S.safe_ratio(F.sum("l_linenumber"), opened)).alias("ratio"))
