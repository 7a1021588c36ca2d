"""The trie of conversation prefixes: padded matrices of turn ids, sorted and summed column by column.

A turn's id is a digest of its role and text together with its place, and a prefix is named by the exclusive-or of its
turns' ids, so a prefix has its name wherever it is met. Conversations are cut to strips of WIDTH turns. Equal strips behind equal
prefixes are counted once, and the distinct ones are dealt to range shards in lexicographic order. A shard is one padded matrix:
``lexsort`` orders its rows, the changes of each column OR-ed with those of the columns before mark where nodes start, and
``reduceat`` sums every depth at once. Nodes on the path of a shard's first or last row may go on in the next shard; only these, and those on the
border of two strips, are combined across shards, by name.

Sums over a subtree reach beyond a strip through the conversations: every node counts for its smallest member alone, so what lies
deeper is summed per conversation and added to the prefixes of that conversation.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import crc32_sql, saved

WIDTH = 32
SHARD_ROWS = 50_000
SALTS = 16
BLANK = np.iinfo(np.int64).min
NODE = ["depth", "a", "b"]
NAME = pa.struct([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
SHARD = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("parent_a", pa.int64()), ("parent_b", pa.int64()), ("band", pa.int64()),
                   ("low", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()),
                   ("goes_on", pa.bool_()), ("edge", pa.bool_()), ("open", pa.bool_()), ("parent_low", pa.int64()), ("path", pa.list_(NAME))])
SHARD_DDL = ("depth long, a long, b long, parent_a long, parent_b long, band long, low long, n_convs long, n_children long, n_leaves long, saved long, words long, "
             "goes_on boolean, edge boolean, open boolean, parent_low long, path array<struct<depth:long,a:long,b:long>>")


def in_order(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, their number within ``conv_id`` (from 1) by ``order``; a very long conversation is spread over range partitions."""
    ranged = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    placed = saved(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), label)
    parts = placed.groupBy("conv_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    return placed.join(parts, ["conv_id", "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, words`` from ``conv_id, turn, role, text``: turns in order, null turns first, ties by role, then by digest of the text.

    Null roles and texts are empty; rows that repeat are turns of their own; rows without conv_id are left out; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    placed = in_order(rows, ["turn", "role", "digest"], "turns")
    return placed.select("conv_id", "pos", F.md5(F.concat_ws(":", F.octet_length("role"), "role", "digest")).alias("key"), "words")


def regrafted(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation c - c % family, then its own without its first h; h = crc32(c) % most.

    Returns the turns and the ``conv_id`` of all conversations, of which some may have no turn left.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    turns = saved(turns, "numbered")
    ids = saved(turns.select("conv_id").distinct(), "conversations")
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "source")
    wanted = ids.withColumn("h", h).where("h > 0").withColumn("source", F.col("conv_id") - F.col("conv_id") % family)
    grafts = wanted.join(heads, "source").where(F.col("pos") <= F.col("h")).select("conv_id", F.lit(0).alias("own"), F.col("pos").alias("was"), "key", "words")
    rest = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("own"), F.col("pos").alias("was"), "key", "words")
    return in_order(grafts.unionAll(rest), ["own", "was"], "rebuilt").select("conv_id", "pos", "key", "words"), ids


def strips_of(turns: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``conv_id, band, turns`` (up to ``width``), the name of the prefix before and of the end, and whether the conversation goes on."""
    marked = turns.select("conv_id", F.floor((F.col("pos") - 1) / width).cast("long").alias("band"), F.struct(
        "pos", F.xxhash64("pos", "key").bitwiseOR(F.lit(1)).alias("a"), F.xxhash64(F.lit(7), "key", "pos").alias("b"), "words").alias("turn"))
    strips = marked.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.a").alias("xa"), F.bit_xor("turn.b").alias("xb"))
    blank = ids.select("conv_id", F.lit(0).cast("long").alias("band"), F.array().cast(strips.schema["turns"].dataType).alias("turns"),
                       F.lit(0).cast("long").alias("xa"), F.lit(0).cast("long").alias("xb"))
    strips = saved(strips.unionAll(blank.join(strips.where("band = 0").select("conv_id"), "conv_id", "left_anti")), "strips")
    order = Window.partitionBy("conv_id").orderBy("band")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = strips.where((F.size("turns") == width) | (F.col("band") > 0)).select(
        "conv_id", "band", F.bit_xor("xa").over(before).alias("pa"), F.bit_xor("xb").over(before).alias("pb"), F.lead("band").over(order).isNotNull().alias("goes_on"))
    pa_, pb_ = F.coalesce("pa", F.lit(0)), F.coalesce("pb", F.lit(0))
    return strips.join(full, ["conv_id", "band"], "left").select(
        "conv_id", "band", "turns", pa_.alias("pa"), pb_.alias("pb"), pa_.bitwiseXOR(F.col("xa")).alias("ea"), pb_.bitwiseXOR(F.col("xb")).alias("eb"),
        (F.col("band") * width + F.size("turns")).alias("end"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"))


def _matrices(rows: pa.Table):
    turns = rows.column("turns").combine_chunks()
    turns = turns if isinstance(turns, pa.ListArray) else turns.chunk(0)
    size = np.diff(turns.offsets.to_numpy()).astype(np.int64)
    flat, width = turns.flatten(), int(size.max()) if len(size) else 0
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = []
    for name, blank in (("a", BLANK), ("b", BLANK), ("words", 0)):
        m = np.full((len(size), width), blank, np.int64)
        m[row, column] = flat.field(name).to_numpy(zero_copy_only=False)
        out.append(m)
    return size, *out


def shard_nodes(rows: pa.Table, width: int) -> pa.Table:
    """Nodes of one shard of distinct strips (``band, pa, pb, turns, n, low, n_on``)."""
    size, ma, mb, words = _matrices(rows)
    band, before_a, before_b, n, low, n_on = (rows.column(c).to_numpy() for c in ("band", "pa", "pb", "n", "low", "n_on"))
    keys = [band, before_a, before_b, *(m[:, j] for j in range(ma.shape[1]) for m in (ma, mb))]
    order = np.lexsort(keys[::-1])
    size, ma, mb, words, band, before_a, before_b, n, low, n_on = (x[order] for x in (size, ma, mb, words, band, before_a, before_b, n, low, n_on))
    r, w = ma.shape
    change = np.ones((r, w + 1), bool)
    change[1:, 0] = (band[1:] != band[:-1]) | (before_a[1:] != before_a[:-1]) | (before_b[1:] != before_b[:-1])
    change[1:, 1:] = (ma[1:] != ma[:-1]) | (mb[1:] != mb[:-1])
    np.logical_or.accumulate(change, axis=1, out=change)
    at_a, at_b = (np.bitwise_xor.accumulate(np.concatenate((p[:, None], m), axis=1), axis=1) for p, m in ((before_a, ma), (before_b, mb)))
    # deepest column first: what starts in a row at this depth or deeper is what its subtrees hold
    deeper_saved, deeper_leaves = np.zeros(r, np.int64), np.zeros(r, np.int64)
    child_start, parts = np.zeros(r, np.int64), []
    lows = np.zeros((r, w + 1), np.int64)
    is_edge = np.zeros((r, w + 1), bool)
    for j in range(w, -1, -1):
        start = np.flatnonzero(change[:, j])
        real = size[start] >= j
        count, least = np.add.reduceat(n, start), np.minimum.reduceat(low, start)
        on = np.add.reduceat(np.where(size == j, n_on, 0), start)
        edge = np.zeros(len(start), bool)
        edge[[0, -1]] = True
        children = np.add.reduceat(child_start, start)
        own = words[start, j - 1] if j else np.zeros(len(start), np.int64)
        closed = real & ~edge & (j > 0)
        gain, leaf = np.where(closed, (count - 1) * own, 0), np.where(closed & (children == 0) & (on == 0), 1, 0)
        deeper_saved[start] += gain
        deeper_leaves[start] += leaf
        sums = [np.add.reduceat(x, start) for x in (deeper_saved, deeper_leaves)]
        lows[:, j], is_edge[:, j] = (np.repeat(x, np.diff(np.append(start, r))) for x in (least, edge | (j == 0)))
        inner = j == 0 and band[start] > 0  # the name of such a root belongs to a node of the strip before
        known = np.where(inner, 0, 1) if j == 0 else 1
        parts.append((start[real], j, (count * known)[real], least[real], children[real], (sums[0] * known)[real], (sums[1] * known)[real], own[real], (on > 0)[real], edge[real] | (j == 0)))
        child_start = np.zeros(r, np.int64)
        child_start[start[real & ~edge]] = 1
    out = {f: [] for f in SHARD.names}
    for start, j, count, least, children, gained, leaves, own, on, edge in parts:
        m = len(start)
        depth, root, first = band[start] * width + j, j == 0, band[start] == 0
        out["depth"].append(depth), out["a"].append(at_a[start, j]), out["b"].append(at_b[start, j]), out["band"].append(band[start])
        up = max(j - 1, 0)
        out["parent_a"].append(pa.array(at_a[start, up], mask=np.full(m, root))), out["parent_b"].append(pa.array(at_b[start, up], mask=np.full(m, root)))
        out["low"].append(pa.array(least, mask=~first if root else None)), out["n_convs"].append(count)
        out["n_children"].append(children), out["n_leaves"].append(leaves), out["saved"].append(gained), out["words"].append(own), out["goes_on"].append(on)
        out["edge"].append(edge & (not root) | (first if root else False))
        out["open"].append(edge | on)
        out["parent_low"].append(pa.array(lows[start, up], mask=np.full(m, True) if root else is_edge[start, up]))
        paths = [None] * m
        for i in np.flatnonzero(edge):
            if not root or first[i]:
                begin = 0 if first[i] else 1
                paths[i] = [{"depth": int(band[start[i]] * width + k), "a": int(at_a[start[i], k]), "b": int(at_b[start[i], k])} for k in range(begin, j + 1)]
        out["path"].append(pa.array(paths, SHARD.field("path").type))
    return pa.table({f: pa.chunked_array([pa.array(x, SHARD.field(f).type) if isinstance(x, np.ndarray) else x.cast(SHARD.field(f).type) for x in out[f]], SHARD.field(f).type)
                     for f in SHARD.names}, schema=SHARD)


def _shards(width: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), width).combine_chunks().to_batches(max_chunksize=1 << 14)

    return run


def _joined_ids(batches):
    """Runs of equal names in sorted rows as comma-joined ids; a run may go on in the next batch."""
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in NODE], axis=1)
        ids = batch.column("conv_id").to_pylist()
        start = np.flatnonzero(np.any(np.diff(names, axis=0, prepend=names[:1]) != 0, axis=1) | (np.arange(len(ids)) == 0)) if len(ids) else []
        stop = [*start[1:], len(ids)] if len(ids) else []
        yield pa.RecordBatch.from_arrays([pa.array(names[start, k] if len(ids) else [], pa.int64()) for k in range(3)] + [
            pa.array([ids[s] for s in start], pa.int64()), pa.array([",".join(map(str, ids[s:e])) for s, e in zip(start, stop)], pa.string())], names=[*NODE, "first", "ids"])


def _hashed_ids(batches):
    name, digest = None, None
    kept = []

    def told():
        return pa.RecordBatch.from_arrays([pa.array([k[0][i] for k in kept], pa.int64()) for i in range(3)] + [pa.array([k[1] for k in kept], pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if (d, a, b) != name:
                if name is not None:
                    kept.append((name, digest.hexdigest()))
                name, digest = (d, a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield told()
        kept.clear()
    if name is not None:
        kept.append((name, digest.hexdigest()))
        yield told()


def end_digests(strips: DataFrame) -> DataFrame:
    """Per node where conversations end: the digest of their ids in order. Ids are joined where they lie in range partitions, so one task only
    hashes a crowded node's joined pieces, one after the other."""
    ends = strips.where(~F.col("goes_on")).select(F.col("end").alias("depth"), F.col("ea").alias("a"), F.col("eb").alias("b"), "conv_id")
    pieces = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined_ids, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*(F.col(c) for c in NODE)).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(_hashed_ids, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every node of the trie of ``turns`` (``conv_id, pos, key, words``; pos from 1 without gaps) with ``ids`` (``conv_id``) as members of its root.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without
    conversations there is no node. Equal keys at equal places after equal prefixes are the same node; conversations may repeat each other.
    """
    strips = saved(strips_of(turns, ids.select("conv_id").distinct(), width), "strips")
    distinct = saved(strips.groupBy("band", "pa", "pb", "ea", "eb", "end").agg(
        F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.count_if("goes_on").alias("n_on")).drop("ea", "eb", "end"), "distinct")
    shards = max(1, -(-distinct.count() // shard_rows))
    nodes = saved(distinct.repartitionByRange(shards, "band", "pa", "pb", "turns").mapInArrow(_shards(width), SHARD_DDL), "nodes")
    closed = nodes.where("NOT open").select(*NODE, "band", "parent_a", "parent_b", "parent_low", "low", "n_convs", "n_children", "n_leaves", "saved", "words")
    open_ = saved(nodes.where("open").groupBy(*NODE).agg(
        F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"), F.max("parent_low").alias("parent_low"), F.min("low").alias("low"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.max("words").alias("words"), F.bool_or("goes_on").alias("goes_on"), F.bool_or("edge").alias("edge"), F.min(F.when(F.col("low").isNotNull(), F.col("band"))).alias("band"),
        F.max("path").alias("path")), "open")
    edges = open_.where("edge")
    counted = edges.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("more"))
    open_ = saved(open_.join(counted, NODE, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "open-counted")
    leaf = ((F.col("n_children") == 0) & ~F.col("goes_on")).cast("long")
    above = open_.where("edge").select(F.explode("path").alias("p"), ((F.col("n_convs") - 1) * F.col("words")).alias("v"), leaf.alias("l"))
    above = above.groupBy("p.depth", "p.a", "p.b").agg(F.sum("v").alias("v"), F.sum("l").alias("l"))
    open_ = saved(open_.join(above, NODE, "left").select(
        *closed.columns[:9], "n_children", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("v", F.lit(0))).alias("saved"), "words"), "open-summed")
    # parents that closed nodes have in the open table; a crowded parent is copied to SALTS shares
    every = closed.unionByName(open_)
    lows = open_.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("low").alias("_up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    far = every.where(F.col("parent_low").isNull() & F.col("parent_a").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    far = far.join(lows, ["depth", "parent_a", "parent_b", "_salt"], "left").withColumn("parent_low", F.col("_up"))
    every = every.where(F.col("parent_low").isNotNull() | F.col("parent_a").isNull()).unionByName(far.select(*every.columns))
    beyond = _beyond(strips, every, width)
    if beyond is not None:
        every = every.join(beyond, NODE, "left").withColumns({
            "saved": F.col("saved") + F.coalesce("v", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0))})
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(end_digests(strips), NODE, "left").select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _beyond(strips: DataFrame, nodes: DataFrame, width: int) -> DataFrame | None:
    """What the strips behind a node's own add to it; None where no conversation is longer than a strip."""
    goes_on = strips.where("goes_on")
    if goes_on.isEmpty():
        return None
    held = nodes.where("band > 0").groupBy(F.col("low").alias("conv_id"), "band").agg(
        F.sum((F.col("n_convs") - 1) * F.col("words")).alias("v"), F.sum((F.col("n_children") == 0).cast("long")).alias("l"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    long_ = strips.where(F.col("goes_on") | (F.col("band") > 0))
    sums = long_.select("conv_id", "band").join(held, ["conv_id", "band"], "left").select(
        "conv_id", "band", F.coalesce(F.sum("v").over(later), F.lit(0)).alias("v"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l")).where("v > 0 OR l > 0")

    def upto(start: str, part: str):
        return lambda j: F.aggregate(F.slice("turns", F.lit(1), j), F.col(start), lambda x, t: x.bitwiseXOR(t[part]))

    first = F.when(F.col("band") == 0, 0).otherwise(1)
    names = F.transform(F.sequence(first, F.size("turns")), lambda j: F.struct(
        (F.col("band") * width + j).alias("depth"), upto("pa", "a")(j).alias("a"), upto("pb", "b")(j).alias("b")))
    rows = goes_on.join(sums, ["conv_id", "band"]).select(F.explode(names).alias("p"), "v", "l")
    return saved(rows.groupBy("p.depth", "p.a", "p.b").agg(F.sum("v").alias("v"), F.sum("l").alias("l")), "beyond")


ORACLE = rf"""
    WITH numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
                      [coalesce(role, ''), coalesce(text, '')] AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT conv_id, {crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM numbered),
    turns AS (SELECT i.conv_id, 0 AS own, pos, said, words FROM ids i JOIN numbered t ON t.conv_id = i.conv_id - i.conv_id % 20 WHERE pos <= h
              UNION ALL SELECT i.conv_id, 1, pos, said, words FROM ids i JOIN numbered t USING (conv_id) WHERE pos > h),
    paths AS (SELECT conv_id, list(said ORDER BY own, pos) AS path, list(words ORDER BY own, pos) AS words FROM turns GROUP BY conv_id),
    whole AS (SELECT conv_id, coalesce(path, []) AS path, coalesce(words, []) AS words FROM ids LEFT JOIN paths USING (conv_id)),
    prefixes AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS d, path, words FROM whole),
    members AS (SELECT d, path[1:d] AS prefix, conv_id, len(path) = d AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w FROM prefixes),
    nodes AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
              sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY d, prefix),
    children AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
    known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (d, prefix)),
    above AS (SELECT unnest(range(0, d + 1)) AS up, prefix, (n_convs - 1) * w AS v, n_children = 0 AS leaf FROM known),
    sums AS (SELECT up AS d, prefix[1:up] AS prefix, sum(v)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM above GROUP BY ALL)
    SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
    FROM known k JOIN sums s USING (d, prefix) LEFT JOIN known p ON p.d = k.d - 1 AND p.prefix = k.prefix[1:k.d - 1]"""
