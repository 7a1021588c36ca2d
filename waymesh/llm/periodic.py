"""Periodic runs of words: suffix trees for longest common extensions, Lyndon roots extended both ways.

Two Ukkonen trees, of the words and of their reversal, answer how far two places agree to the right and to the left: that is
the depth of the lowest common ancestor of two leaves, the least depth that an Euler tour meets between them, looked up in
a table of minima over powers of two. The tree's leaves in lexicographic order, under the usual and the reversed order of words, give
the longest Lyndon word from every place; each is a candidate root, extended to both sides.

Before that a text falls into stretches: a run of at least four periods holds each of its word pairs three times or more, so
a pair that a stretch holds less often is on no run and cuts it. That is repeated until nothing is cut; every run
lies whole in one stretch. Stretches of many texts share one pair of trees, each ended by a symbol of its own.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc32_sql
from .words import BLOCK, SPACE, mix, word_hashes

LEAST_LENGTH, LEAST_PERIODS = 6, 4
GROUP_WORDS, TREE_WORDS = 1 << 18, 1 << 15
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """Ukkonen's tree of a sequence whose symbols at and above ``ends`` occur once each; the last symbol is one of those."""

    def __init__(self, symbols: list[int], ends: int):
        self.n, self.ends = len(symbols), ends
        self._build(symbols)
        sign = np.array(self.symbol, np.int64)
        parent = np.array(self.parent, np.int64)
        closing = sign >= ends
        # closing symbols come before all words, in either order of the words
        self.suffix, self.gaps = self._tour(np.lexsort((np.where(closing, sign - ends - self.n, sign), parent)), parent)
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.suffix] = np.arange(self.n)
        self._sign, self._parent, self._closing = sign, parent, closing

    def _build(self, s: list[int]) -> None:
        n, sigma = self.n, max(s) + 1
        start, stop, link, parent, symbol, leaf = [0], [0], [0], [-1], [0], [-1]
        child_of: dict[int, int] = {}
        node = edge = size = waiting = leaves = 0
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not size:
                    edge = i
                key = node * sigma + s[edge]
                child = child_of.get(key)
                if child is None:
                    child_of[key] = len(start)
                    start.append(i), stop.append(n), link.append(0), parent.append(node), symbol.append(s[edge]), leaf.append(leaves)
                    leaves += 1
                    if last:
                        link[last], last = node, 0
                else:
                    at = start[child]
                    length = (stop[child] if leaf[child] < 0 else i) - at
                    if size >= length:
                        node, edge, size = child, edge + length, size - length
                        continue
                    if s[at + size] == c:
                        size += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    child_of[key] = middle
                    start.append(at), stop.append(at + size), link.append(0), parent.append(node), symbol.append(s[edge]), leaf.append(-1)
                    start[child] = at + size
                    parent[child], symbol[child] = middle, s[at + size]
                    child_of[middle * sigma + s[at + size]] = child
                    child_of[middle * sigma + c] = middle + 1
                    start.append(i), stop.append(n), link.append(0), parent.append(middle), symbol.append(c), leaf.append(leaves)
                    leaves += 1
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif size:
                    size -= 1
                    edge = i - waiting + 1
        self.start, self.stop, self.parent, self.symbol, self.leaf = start, stop, parent, symbol, leaf

    def _tour(self, order: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves from left to right and, between two of them, the least depth of the Euler tour."""
        leaf, start, stop = self.leaf, self.start, self.stop
        low = np.searchsorted(parent[order], np.arange(len(parent) + 1)).tolist()
        kids = order.tolist()
        leaves, gaps = [], []
        nodes, depths, turns = [0], [0], [-1]
        while nodes:
            v, depth, turn = nodes.pop(), depths.pop(), turns.pop()
            if turn >= 0:
                gaps.append(turn)
            if leaf[v] >= 0:
                leaves.append(leaf[v])
                continue
            depth += stop[v] - start[v]
            below = kids[low[v]:low[v + 1]]
            below.reverse()
            nodes += below
            depths += [depth] * len(below)
            turns += [depth] * (len(below) - 1)
            turns.append(-1)
        return np.array(leaves, np.int64), np.array(gaps, np.int32)

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes when words are ordered the other way round; closing symbols stay first."""
        key = np.where(self._closing, self._sign - self.ends - self.n, self.ends - self._sign)
        leaves, _ = self._tour(np.lexsort((key, self._parent)), self._parent)
        rank = np.empty(self.n, np.int64)
        rank[leaves] = np.arange(self.n)
        return rank

    def prepare(self) -> None:
        """The least gap of every stretch of a power of two."""
        self.table = [self.gaps]
        width = 1
        while 2 * width <= len(self.gaps):
            before = self.table[-1]
            self.table.append(np.minimum(before[:-width], before[width:]))
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` (different places) have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank: where the longest Lyndon word from each place ends."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][1] > r:
            out[stack.pop()[0]] = i
        stack.append((i, r))
    return np.array(out, np.int64)


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``start, length, period`` of the runs of several stretches; ``words`` are small numbers, ``bounds`` the stretches' ends.

    Places count from the first word of all, closing symbols not counted.
    """
    ends = int(words.max()) + 1
    n = len(words) + len(bounds)
    closing = bounds + np.arange(len(bounds))
    symbols = np.empty(n, np.int64)
    symbols[closing] = ends + np.arange(len(bounds))
    inner = np.ones(n, bool)
    inner[closing] = False
    symbols[inner] = words
    forward = SuffixTree(symbols.tolist(), ends)
    # the reversal keeps a closing symbol at its end
    backward = SuffixTree([*symbols[:-1][::-1].tolist(), int(symbols[-1])], ends)
    forward.prepare()
    backward.prepare()
    place = np.flatnonzero(inner)
    roots = []
    for rank in (forward.rank, forward.reversed_rank()):
        end = next_smaller(rank)[place]
        at = inner[np.minimum(end, n - 1)] & (end < n)  # a root that ends with its stretch cannot be repeated
        roots.append(np.stack([place[at], end[at]]))
    a, b = np.concatenate(roots, axis=1)
    right = forward.common(a, b)
    left = np.zeros(len(a), np.int64)
    some = (a > 0)
    left[some] = backward.common(n - 1 - a[some], n - 1 - b[some])
    start, period = a - left, b - a
    length = period + left + right
    good = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
    found = np.unique(np.stack([start[good], length[good], period[good]], axis=1), axis=0)
    found[:, 0] -= np.searchsorted(closing, found[:, 0])
    return found


def stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of texts (their words in a row, ``first`` their first places) that can hold a run."""
    n = len(words)
    joined = np.ones(max(n - 1, 0), bool)
    joined[first[(first > 0) & (first < n)] - 1] = False  # joined[i]: words i and i + 1 belong together
    while True:
        edge = np.diff(joined.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= LEAST_LENGTH - 1
        start, end = start[long], end[long]
        if not len(start):
            return start, end
        sizes = end - start
        spot = np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        with np.errstate(over="ignore"):
            pair = mix(words[spot] * np.uint64(3) + mix(words[spot + 1])) + np.repeat(mix(start.astype(np.uint64)), sizes)
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        stay = count[which] >= LEAST_PERIODS - 1
        left = np.zeros(len(joined), bool)
        left[spot[stay]] = True
        if stay.all():
            return start, end + 1
        joined = left


def runs_of_texts(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """``start, length, period`` of every run of each text, given as one hash per word; by start, then period."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    first = np.cumsum(sizes) - sizes
    out = [np.empty((0, 3), np.int64)] * len(hashes)
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    start, end = stretches(words, first)
    found, at = [], 0
    while at < len(start):
        upto = at + 1  # a stretch longer than TREE_WORDS has trees of its own
        total = end[at] - start[at]
        while upto < len(start) and total + end[upto] - start[upto] <= TREE_WORDS:
            total += end[upto] - start[upto]
            upto += 1
        lengths = end[at:upto] - start[at:upto]
        bounds = np.cumsum(lengths)
        spot = np.arange(bounds[-1]) + np.repeat(start[at:upto] - (bounds - lengths), lengths)
        got = runs_of(np.unique(words[spot], return_inverse=True)[1], bounds)
        got[:, 0] = spot[got[:, 0]]
        found.append(got)
        at = upto
    if found:
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        text = np.searchsorted(first, rows[:, 0], side="right") - 1
        for t in np.unique(text):
            mine = rows[text == t].copy()
            mine[:, 0] -= first[t]
            out[t] = mine
    return out


def collapsed(data: bytes, n_words: int, runs: np.ndarray) -> bytes:
    """The words joined by one space, without those behind the first period of a run."""
    keep = np.ones(n_words, bool)
    if len(runs):
        change = np.zeros(n_words + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        keep = np.cumsum(change)[:-1] == 0
    parts, at, seen = [], 0, 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        words = data[at:end].split()
        if len(runs):
            flags = keep[seen:seen + len(words)].tolist()
            seen += len(words)
            words = [w for w, stay in zip(words, flags) if stay]
        if words:
            parts.append(b" ".join(words))
        at = end
    return b" ".join(parts)


def _scan(batches):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            hashes, total, upto = [], 0, at
            while upto < len(texts) and (upto == at or total < GROUP_WORDS):
                hashes.append(word_hashes(texts[upto] or b""))
                total += len(hashes[-1])
                upto += 1
            runs = runs_of_texts(hashes)
            short = [collapsed(t or b"", len(h), r) for t, h, r in zip(texts[at:upto], hashes, runs)]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            flat = np.concatenate(runs)
            made = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([ids.slice(at, upto - at), pa.array([len(h) for h in hashes], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets), made), pa.array(short, pa.binary()).cast(pa.string())], schema=SCHEMA)
            at = upto


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs`` (``doc_id, text``; other columns are ignored).

    Words are ``[^\\x20\\x09-\\x0D]+``. ``runs`` holds every run (``start, length, period``) of at least four periods and six words, by
    start, then period; ``collapsed`` is the text without what repeats a run's first period. Null and empty texts have no
    word and no run. Rows with null or repeated ids come out once each. One text is scanned in one task; beside
    the text that takes some 150 bytes per word of its longest stretch that can hold a run.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, DDL)


def collapse(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every run cut to its first period."""
    return find_runs(docs).select("doc_id", F.col("collapsed").alias("text"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where h = crc32(doc_id) ends in 0, every word from a place on repeats the period that starts there.

    With n words and g = h / 10 the place is a = g % n and the period 1 + (n - a) / (3 + g % 8), both in whole numbers. Other texts, and those without doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(h % 10 == 0, words).alias("_w"), F.floor(h / 10).alias("_g"))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int")).withColumn(
        "_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    copies = F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))
    again = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(F.flatten(copies), F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Figures of found runs: their number, the longest one (ties: least start, then period), and digests of all of them and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("_best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.l")).alias("length"), F.col("_best.p").alias("period"),
                       F.floor(-F.col("_best.l") * 1000 / F.col("_best.p")).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Runs in SQL: equal places q apart in a row, found from equal five-word windows; of a stretch's periods the least counts.
ORACLE = rf"""
    WITH texts AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                   coalesce({crc32_sql('doc_id::VARCHAR')}, 1) AS h FROM documents),
    places AS (SELECT *, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts),
    made AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places),
    docs AS (SELECT k, doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM made),
    words AS (SELECT k, n, w, unnest(range(0, n)) AS i FROM docs),
    windows AS (SELECT k, n, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS x FROM words WHERE i + 5 <= n),
    equal AS (SELECT b.k, b.i - a.i AS q, b.i AS i FROM windows a JOIN windows b ON a.k = b.k AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= b.n),
    islands AS (SELECT k, q, min(i) AS i, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM equal) GROUP BY k, q, island),
    least AS (SELECT k, i - q AS start, m + 4 + q AS length, min(q) AS period FROM islands WHERE m + 4 + q >= greatest(6, 4 * q) GROUP BY k, i - q, m + 4 + q),
    told AS (SELECT k, count(*) AS n_runs, min((-length, start, period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM least GROUP BY k),
    gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM least),
    stays AS (SELECT k, string_agg(w[i + 1], ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, (1000 * -best[1]) // best[3] AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM docs LEFT JOIN told USING (k) LEFT JOIN stays USING (k)"""
