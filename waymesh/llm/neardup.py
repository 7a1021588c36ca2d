"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning of signatures, exact verification.

Documents with the same shingle set form a class first; only one member of each class goes on. Every band
bucket links its members to one pivot, never to each other. Where buckets still hold several components after
that, they are joined to families, and the minority members of a family meet all the others in blocks of bounded
size, so no link is lost and no bucket is cut.
"""
from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from .shared import discard, only_ids, saved, sweep
from .words import mix, shingle_set

SHINGLE, BANDS, ROWS = 5, 32, 4
LINK_PART, LINK_WHOLE = 75, 100
MISS = 1e-6
BATCH = 16
BLOCK = 256
SLICE = 2048


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        return a, mix(a)


def signature(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each of ``n`` hash functions over the set, as 32-bit numbers."""
    a, b = _hash_family(n)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), SLICE):
            x = shingles[at:at + SLICE]
            least = np.minimum(least, ((a[:, None] * x[None, :] + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return least


def least_matches(n: int, miss: float = MISS) -> int:
    """Fewest equal values of ``n`` that keep a pair: under a uniform prior the posterior chance of a similarity
    of at least 0.75 after m matches is P(Binomial(n + 1, 0.75) <= m); below ``miss`` the pair is dropped."""
    total, p = 0.0, LINK_PART / LINK_WHOLE
    for m in range(n + 1):
        total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def likely(left: np.ndarray, right: np.ndarray, miss: float = MISS) -> np.ndarray:
    """Which rows of two signature matrices stay after comparing them batch by batch."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int32)
    for at in range(0, left.shape[1], BATCH):
        equal[alive] += (left[alive, at:at + BATCH] == right[alive, at:at + BATCH]).sum(axis=1, dtype=np.int32)
        alive = alive[equal[alive] >= least_matches(at + BATCH, miss)]
        if not len(alive):
            break
    return alive


def _signatures(batches):
    for pdf in batches:
        out = []
        for doc, text in zip(pdf.doc_id, pdf.text):
            s = shingle_set(text.encode() if isinstance(text, str) else b"", SHINGLE)
            if not len(s):
                out.append((doc, 0, None, None, None))
                continue
            sig = signature(s)
            with np.errstate(over="ignore"):
                bands = mix(mix(sig.reshape(BANDS, ROWS).astype(np.uint64) * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                            + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out.append((doc, len(s), hashlib.md5(s.tobytes()).digest(), (sig & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), bands.view(np.int64)))
        yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_digest", "signature", "bands"])


def _sets(batches):
    for pdf in batches:
        sets = [shingle_set(t.encode(), SHINGLE).tobytes() for t in pdf.text]
        yield pd.DataFrame({"doc_id": pdf.doc_id, "set_digest": [hashlib.md5(s).digest() for s in sets], "shingles": sets})


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if LINK_WHOLE * len(small) < LINK_PART * len(large):
        return False
    spot = np.searchsorted(large, small)
    shared = int((large[np.minimum(spot, len(large) - 1)] == small).sum())
    return LINK_WHOLE * shared >= LINK_PART * (len(a) + len(b) - shared)


def _exact(batches):
    for pdf in batches:
        keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(pdf.set_a, pdf.set_b)]
        yield pdf.loc[keep, ["a", "b"]]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _survivors(batches):
    for pdf in batches:
        if len(pdf):
            yield pdf.iloc[likely(_matrix(pdf.sig_a), _matrix(pdf.sig_b))][["a", "b"]]


def _candidates(left: pd.DataFrame, right: pd.DataFrame):
    """For each left row: right rows of other components that share a band and survive the signature test, best first."""
    if not len(left) or not len(right):
        return
    sig_r, comp_r = _matrix(right.signature), right.component.to_numpy()
    for i, (comp, sig) in enumerate(zip(left.component, _matrix(left.signature))):
        other = np.flatnonzero(comp_r != comp)
        equal = sig_r[other] == sig
        band = equal.reshape(len(other), BANDS, ROWS).all(axis=2).any(axis=1)
        other, same = other[band], equal[band].sum(axis=1)
        stay = likely(np.broadcast_to(sig, (len(other), len(sig))), sig_r[other])
        yield i, other[stay][np.argsort(-same[stay], kind="stable")]


def _nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The best candidate of each left row in this block."""
    out = []
    for i, found in _candidates(left, right):
        if len(found):
            same = int((np.frombuffer(left.signature.iat[i], np.uint16) == np.frombuffer(right.signature.iat[found[0]], np.uint16)).sum())
            out.append((left.doc_id.iat[i], right.doc_id.iat[found[0]], same))
    return pd.DataFrame(out, columns=["a", "b", "same"])


def _exact_links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Verified links of each left row in this block, one per component that it meets."""
    out = []
    for i, found in _candidates(left, right):
        mine, met = np.frombuffer(left.shingles.iat[i], np.uint64), set()
        for j in found:
            comp = right.component.iat[j]
            if comp not in met and linked(mine, np.frombuffer(right.shingles.iat[j], np.uint64)):
                met.add(comp)
                out.append((left.doc_id.iat[i], right.doc_id.iat[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _sets_of(ids: DataFrame, docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Full shingle sets of some documents, made from their texts."""
    wanted = saved(ids.distinct(), "ids")
    chosen = only_ids(docs.where(F.col("text").isNotNull()), wanted, "doc_id")
    made = chosen.mapInPandas(_sets, "doc_id long, set_digest binary, shingles binary")
    sets = made.select("doc_id", "shingles")
    if repeated is not None:
        least = made.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("shingles", "set_digest").alias("shingles"))
        sets = made.join(repeated, "doc_id", "left_anti").select("doc_id", "shingles").unionAll(least)
    sets = saved(sets, "sets")
    discard(wanted)
    return sets


def _surviving(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that stay after comparing their signatures batch by batch."""
    both = (pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b")), "b")
            .join(sigs.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a")), "a"))
    return saved(both.mapInPandas(_survivors, "a long, b long"), "survivors")


def _verify(pairs: DataFrame, docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``a, b`` of the pairs (a saved table, dropped afterwards) whose full sets are linked."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, repeated)
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a"))
    links = saved(both.mapInPandas(_exact, "a long, b long"), "links")
    discard(sets)
    discard(pairs)
    del both, sets
    sweep(docs.sparkSession)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; ``docs`` needs ``doc_id`` and ``text``.

    Null, empty and blank texts have no shingle, are linked with nothing and stay. Texts of fewer than five words
    are one shingle. Equal texts are linked. Rows that repeat a doc_id come out once each with the same component;
    the text with the smallest set digest stands for the id. Rows without doc_id are left out. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    marks = saved(docs.mapInPandas(_signatures, "doc_id long, n_shingles long, set_digest binary, signature binary, bands array<long>"), "marks")
    filled = marks.where(F.col("n_shingles") > 0)
    repeated = saved(filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        repeated = None
    else:
        least = filled.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
            F.min("set_digest").alias("set_digest"), *(F.min_by(c, "set_digest").alias(c) for c in ("n_shingles", "signature", "bands")))
        filled = filled.join(repeated, "doc_id", "left_anti").unionByName(least)
    # classes of equal sets: the smallest id per share of a set, then per set; no class meets in one task
    shares = filled.select("set_digest", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("share"))
    first = shares.groupBy("set_digest", "share").agg(F.min("doc_id").alias("low"))
    first = saved(first.select("set_digest", "share", F.min("low").over(Window.partitionBy("set_digest")).alias("class_id")), "classes")
    member = shares.join(first, ["set_digest", "share"]).select("doc_id", "class_id")
    reps = saved(filled.join(first.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
                 .select("doc_id", "signature", "bands"), "representatives")
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = saved(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot")).where(F.col("size") > 1), "buckets")
    crowd = saved(rows.join(buckets, "bucket"), "bucket-rows")
    discard(buckets)
    sweep(docs.sparkSession)
    sigs = reps.select("doc_id", "signature")
    star = saved(crowd.where(F.col("doc_id") != F.col("pivot")).groupBy(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("bands")), "star")
    # first every document with the pivot that it shares most bands with; of the other pairs only those whose ends are still apart
    best = star.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a")).select("a", "b")
    links = _verify(_surviving(best, sigs), docs, repeated)
    labels = _labels(links)
    rest = _named(star.withColumnRenamed("b", "doc_id"), labels).select(F.col("a").alias("doc_id"), F.col("doc_id").alias("b"), F.col("component").alias("of_b"))
    rest = saved(_named(rest, labels).where("component <> of_b").select(F.col("doc_id").alias("a"), "b"), "rest")
    discard(star)
    if not rest.isEmpty():
        labels = _joined(labels, _verify(_surviving(rest, sigs), docs, repeated))
    discard(rest)
    families = _families(crowd, labels)
    discard(crowd)
    if not families.isEmpty():
        # most minority members join their nearest neighbour's component; what is still apart is verified pair by pair
        nearest = _blocks(_open(families, labels).join(sigs, "doc_id"), _nearest, "a long, b long, same long")
        nearest = saved(nearest.groupBy("a").agg(F.max_by("b", F.struct("same", F.col("b"))).alias("b")), "nearest")
        labels = _joined(labels, _verify(nearest, docs, repeated))  # which drops ``nearest``
        apart = saved(_open(families, labels), "apart")
        sets = _sets_of(apart.select("doc_id"), docs, repeated)
        links = saved(_blocks(apart.join(sigs, "doc_id").join(sets, "doc_id"), _exact_links, "a long, b long"), "links")
        discard(sets)
        discard(apart)
        labels = _joined(labels, links)
    named = member.join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select(
        "doc_id", F.coalesce("component", "class_id").alias("component_id"))
    out = marks.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).select("doc_id", "n_shingles", "component_id", "kept")


def _labels(links: DataFrame) -> DataFrame:
    """``node, component`` of the links, saved; shuffles of the rounds are swept away."""
    labels = saved(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "labels")
    sweep(links.sparkSession)
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only components that these join go through rounds, under their names."""
    ends = _named(links.withColumnRenamed("a", "doc_id"), labels).select(F.col("component").alias("src"), F.col("b").alias("doc_id"))
    edges = saved(_named(ends, labels).where("src <> component").select("src", F.col("component").alias("dst")).distinct(), "edges")
    discard(links)
    if edges.isEmpty():
        return labels
    names = saved(connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("name")), "names")
    fresh = names.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("name").alias("component"))
    new = labels.join(names, "component", "left").select("node", F.coalesce("name", "component").alias("component"))
    out = saved(new.unionAll(fresh), "labels")
    for old in (labels, edges, names):
        discard(old)
    sweep(edges.sparkSession)
    return out


def _families(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, family``: documents that are connected through buckets of three or more with several components."""
    named = _named(crowd.where(F.col("size") > 2), labels)
    mixed = saved(named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"), "mixed")
    edges = saved(crowd.join(mixed, "bucket").select(F.col("doc_id").alias("src"), F.col("pivot").alias("dst")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("family"))
    families = saved(connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "families")
    discard(edges)
    discard(mixed)
    sweep(edges.sparkSession)
    return families


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _open(families: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of families with several components; ``minor`` marks all but the largest component's."""
    named = _named(families, labels)
    sizes = named.groupBy("family", "component").agg(F.count("*").alias("n"))
    mixed = saved(sizes.groupBy("family").agg(F.max_by("component", F.struct("n", F.col("component"))).alias("major"),
                                              F.sum("n").alias("all_n"), F.max("n").alias("major_n")).where("all_n > major_n"), "mixed")
    return named.join(mixed, "family").select("family", "doc_id", "component", (F.col("component") != F.col("major")).alias("minor"),
                                              "all_n", (F.col("all_n") - F.col("major_n")).alias("minor_n"))


def _blocks(rows: DataFrame, pairs_of, schema: str) -> DataFrame:
    """Minority members against all members of their family, in groups of about BLOCK by BLOCK documents."""
    lefts, rights = F.ceil(F.col("minor_n") / BLOCK).cast("long"), F.ceil(F.col("all_n") / BLOCK).cast("long")
    mark, zero = F.xxhash64("doc_id"), F.lit(0).cast("long")
    left = rows.where("minor").withColumn("lb", F.pmod(mark, lefts)).withColumn("rb", F.explode(F.sequence(zero, rights - 1)))
    right = rows.withColumn("rb", F.pmod(mark, rights)).withColumn("lb", F.explode(F.sequence(zero, lefts - 1)))
    key = ["family", "lb", "rb"]
    columns = key + [c for c in ("doc_id", "component", "signature", "shingles") if c in rows.columns]
    left, right = (side.select(*(F.col(c).alias(c) for c in columns)) for side in (left, right))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(pairs_of, schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the smallest id of every group of near-duplicates, with the same columns."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
