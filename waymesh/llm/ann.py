"""Approximate nearest neighbours on a robust-pruned directed graph per shard.

Vectors get one more coordinate that gives all of a shard the same length, so nearest by Euclid is largest by inner product.
A shard holds vectors of one band of lengths, as far shorter ones would all be the same point beside the longest. Each shard builds its graph in batches: a greedy search from the middle proposes neighbours for every node, relaxed pruning
keeps a neighbour only if no kept one is clearly closer to it, and edges back are added and pruned likewise. Beam search
then answers blocks of queries on every shard, and the best of all shards are merged. Equal vectors are one node.
"""
from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import saved, scratch

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 160, 1.2
BATCH, SHARD_NODES, QUERY_BLOCK = 512, 16_384, 512
TOP, EVERY = 20, 20
SHARE = 64
#: Shards hold lengths within this factor; doubles span fewer bands than BANDS.
BAND, BANDS = 1.4, 8192


def beam_search(vectors: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (descending inner product, negated) of the best ``width`` nodes found for each query.

    All queries advance together: each expands its nearest node that was not expanded yet, until none has one.
    """
    q = len(queries)
    ids = np.full((q, width), -1, np.int64)
    dist = np.full((q, width), np.inf, np.float32)
    done = np.ones((q, width), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, -(queries @ vectors[entry]), False
    seen = np.zeros((q, len(vectors) + 1), bool)
    seen[:, [entry, -1]] = True  # the last column stands for missing neighbours
    live = np.arange(q)
    while len(live):
        open_dist = np.where(done[live], np.inf, dist[live])
        best = open_dist.argmin(axis=1)
        going = np.isfinite(open_dist[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        known = seen[live[:, None], near]
        seen[live[:, None], near] = True
        new = -np.einsum("qd,qnd->qn", queries[live], vectors[np.maximum(near, 0)])
        new[known] = np.inf
        all_ids, all_dist = np.concatenate((ids[live], near), axis=1), np.concatenate((dist[live], new), axis=1)
        all_done = np.concatenate((done[live], np.isinf(new)), axis=1)
        keep = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        rows = np.arange(len(live))[:, None]
        ids[live], dist[live], done[live] = all_ids[rows, keep], all_dist[rows, keep], all_done[rows, keep]
    order = dist.argsort(axis=1, kind="stable")
    rows = np.arange(q)[:, None]
    return ids[rows, order], dist[rows, order]


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE diverse neighbours per node: the nearest is kept, and whatever it is ALPHA times closer to goes."""
    same = (candidates == nodes[:, None]) | (candidates < 0)
    # seen from the node, so that what cancels below is small beside the distances that are compared
    points = vectors[np.maximum(candidates, 0)] - vectors[nodes][:, None, :]
    to_node = (points**2).sum(axis=2)
    to_node[same] = np.inf
    order = to_node.argsort(axis=1, kind="stable")
    rows = np.arange(len(nodes))[:, None]
    candidates, points, to_node = candidates[rows, order], points[rows, order], to_node[rows, order]
    twice = np.zeros(candidates.shape, bool)
    by_id = candidates.argsort(axis=1, kind="stable")
    sorted_ids = candidates[rows, by_id]
    twice[rows, by_id[:, 1:]] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    alive = np.isfinite(to_node) & ~twice
    out = np.full((len(nodes), DEGREE), -1, np.int64)
    one = np.arange(len(nodes))
    length = (points**2).sum(axis=2)
    between = np.maximum(0.0, length[:, :, None] + length[:, None, :] - 2 * (points @ points.transpose(0, 2, 1)))
    for slot in range(DEGREE):
        first = alive.argmax(axis=1)
        has = alive[one, first]
        if not has.any():
            break
        out[has, slot] = candidates[one, first][has]
        alive &= ~((ALPHA**2 * between[one, first] <= to_node) & has[:, None])
        alive[one, first] = False
    return out


def build_graph(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Neighbours (-1: none) of every node and the entry node, which is nearest to the mean."""
    n = len(vectors)
    order = np.random.default_rng(7).permutation(n)
    graph = np.full((n, DEGREE), -1, np.int64)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    start = order[:min(n, 2 * DEGREE)]
    graph[start] = robust_prune(vectors, start, np.broadcast_to(start, (len(start), len(start))))
    graph[entry] = robust_prune(vectors, np.array([entry]), start[None, :])[0]
    size = 2 * DEGREE
    at = len(start)
    while at < n:  # batches grow with the graph, so early nodes do not miss each other
        batch = order[at:at + min(size, BATCH)]
        at, size = at + len(batch), size * 2
        found, _ = beam_search(vectors, graph, entry, vectors[batch], BUILD_BEAM)
        graph[batch] = robust_prune(vectors, batch, np.concatenate((found, graph[batch]), axis=1))
        _link_back(vectors, graph, batch)
    return graph, entry


def _link_back(vectors: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    source = np.repeat(batch, DEGREE)
    target = graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(nodes), BATCH):
        part, starts, sizes = nodes[low:low + BATCH], first[low:low + BATCH], count[low:low + BATCH]
        wide = np.full((len(part), int(sizes.max())), -1, np.int64)
        spot = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide[np.repeat(np.arange(len(part)), sizes), spot] = source[np.repeat(starts, sizes) + spot]
        for at in range(0, wide.shape[1], 2 * DEGREE):  # a node that many chose is pruned again and again, in bounded memory
            more = wide[:, at:at + 2 * DEGREE]
            touched = (more >= 0).any(axis=1)
            own = graph[part[touched]]
            graph[part[touched]] = robust_prune(vectors, part[touched], np.concatenate((own, more[touched]), axis=1))


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: neither null nor zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """``v, ids``: each vector once with its ``copies`` smallest ids. A vector that very many rows share is ranked by shares."""
    share = Window.partitionBy("v", "share").orderBy("vec_id")
    few = rows.distinct().withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(SHARE))).withColumn("own", F.row_number().over(share)).where(F.col("own") <= copies)
    few = few.withColumn("own", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("own") <= copies)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Every row at length 1, whatever its scale."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _lifted(exact: np.ndarray) -> np.ndarray:
    """The vectors by the longest of them, with one more coordinate that makes all length 1."""
    scaled = exact / np.abs(exact).max()
    scaled = scaled / np.linalg.norm(scaled, axis=1).max()
    return np.concatenate((scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))[:, None]), axis=1).astype(np.float32)


def _build(root: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[pdf.ids.map(lambda x: x[0]).argsort(kind="stable").to_numpy()]
        exact = _matrix(pdf.v)
        wide = _lifted(exact)
        graph, entry = build_graph(wide)
        copies = np.array([len(x) for x in pdf.ids])
        held = io.BytesIO()
        np.savez(held, exact=exact, wide=wide, graph=graph.astype(np.int32), entry=entry, copies=copies, ids=np.concatenate([np.asarray(x, np.int64) for x in pdf.ids]))
        store, folder = fs.FileSystem.from_uri(root)
        shard = int(pdf.shard.iat[0])
        attempt, name = f"{folder}/shard-{shard}.{uuid.uuid4().hex}", f"{folder}/shard-{shard}.npz"
        with store.open_output_stream(attempt, compression=None) as out:
            out.write(held.getvalue())
        store.move(attempt, name)
        return pd.DataFrame({"shard": [shard], "nodes": [len(pdf)]})

    return build


def _load(root: str, shard: int) -> dict:
    store, folder = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{folder}/shard-{shard}.npz", compression=None) as data:
        return dict(np.load(io.BytesIO(data.read())))


def _query(root: str, top: int, beam: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        index = _load(root, int(pdf.shard.iat[0]))
        exact, starts = index["exact"], np.cumsum(index["copies"]) - index["copies"]
        q = _matrix(pdf.v)
        wide = np.concatenate((_unit(q), np.zeros((len(q), 1))), axis=1).astype(np.float32)
        found, _ = beam_search(index["wide"], index["graph"], int(index["entry"]), wide, beam)
        out = []
        for qid, vector, nodes in zip(pdf.query_id, q, found):
            nodes = nodes[nodes >= 0]
            score = (exact[nodes] * vector).sum(axis=1)
            rows = [(-s, int(i), int(n)) for s, n in zip(score, nodes) for i in index["ids"][starts[n]:starts[n] + index["copies"][n]] if i != qid]
            out += [(qid, i, -s) for s, i, _ in sorted(rows)[:top]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return answer


def build_index(vectors: DataFrame, copies: int, shard_nodes: int = SHARD_NODES) -> tuple[str, int]:
    """Write one graph per shard to the shared folder; every vector is in it. Returns the folder and the number of shards."""
    spark = vectors.sparkSession
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    nodes = distinct_vectors(vectors, copies).withColumn("size", F.size("v")).withColumn("most", most)
    nodes = saved(nodes.withColumn("log_length", F.log("most") + F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))) / 2), "nodes")
    stats = nodes.agg(F.count("*").alias("n"), F.max(F.struct("size", "log_length")).alias("top")).first()
    root = scratch(spark, "index")
    if "://" not in root:
        root = f"file://{root}" if not root.startswith("file:") else root.replace("file:", "file://", 1)
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    if not stats["n"]:
        return root, 0
    dim, longest = stats["top"]
    placed = nodes.where(F.col("size") == dim).withColumn("band", F.floor((F.lit(longest) - F.col("log_length")) / math.log(BAND)).cast("int"))
    parts = placed.groupBy("band").agg(F.ceil(F.count("*") / shard_nodes).alias("parts"))
    placed = placed.join(F.broadcast(parts), "band").withColumn("shard", (F.col("band") + BANDS * F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int"))
    built = saved(placed.select("shard", "v", "ids").groupBy("shard").applyInPandas(_build(root), "shard int, nodes long"), "shards")
    return root, [r["shard"] for r in built.select("shard").collect()]


def search(queries: DataFrame, index: tuple[str, list[int]], top: int = TOP, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: queries (``query_id, v``) in blocks against every shard, merged by score and vec_id."""
    root, shards = index
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.array(*(F.lit(s) for s in shards)) if shards else F.array().cast("array<int>")))
    found = asked.groupBy("shard", "block").applyInPandas(_query(root, top, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """Nearest neighbours of every vector whose vec_id is divisible by ``every`` among all others.

    Null, zero or non-finite vectors take no part; vectors of another length than the longest take none either. Rows that
    repeat a vec_id with another vector are candidates each; exact repetitions count once. An empty table gives no rows.
    """
    rows = saved(clean(vectors), "vectors")
    index = build_index(rows, top + 1)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    queries = rows.where((F.pmod(F.col("vec_id"), F.lit(every)) == 0) & (F.size("v") == (dim or 0))).select(F.col("vec_id").alias("query_id"), "v").distinct()
    return search(queries, index if index[1] else (index[0], []), top)
