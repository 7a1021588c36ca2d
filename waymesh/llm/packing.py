"""Packing by cutting stock: column generation over the histogram of piece lengths.

Documents are cut at every multiple of the sequence length; only the rest of each needs a partner. Rests are counted by
length class (multiples of ``GRID_TOKENS``, at most 256 counts reach the driver), a linear program over patterns of classes
is solved by column generation, each new pattern being the best knapsack by dynamic programming, and whole pattern
counts are dealt to the pieces by their rank within the class. Ranks come from salted windows, so a length that a third of
all documents share is spread like any other.
"""
from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_frames, salts_for, saved

SEQUENCE, END_ID, GRID_TOKENS = 4096, 2, 16
CACHE_WORDS = 350_000
BATCH_MISSES = 4096
WORD_END = "</w>"
SEPARATORS = re.compile("[\x1c-\x1f]")
#: One comma or stop between a Latin letter or digit and white space is a word of its own to the tokenizer.
OTHER_MARK = re.compile(r"(?<![0-9A-Za-z\u00df-\u00f6\u00f8-\u00ff])[.,](?!\S)")
LAST_MARK = re.compile(r"(?<=[0-9A-Za-z\u00df-\u00f6\u00f8-\u00ff])([.,])(?!\S)")


class WordTokens:
    """Ids of texts by a tokenizers file whose words are parted by white space. Words seen of late are looked up.

    The file drops white space and normalises within words only, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the task its one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        young, old = self.young, self.old
        words_of = [_words(t) for t in texts]
        found_of = [list(map(young.get, words)) for words in words_of]
        fresh: list[str] = []
        for words, found in zip(words_of, found_of):
            for i in [i for i, ids in enumerate(found) if ids is None]:
                w = words[i]
                if w not in young:
                    young[w] = old.get(w)
                    if young[w] is None:
                        fresh.append(w)
        # words of letters alone are one piece each, whose last token bears the end mark: they go in as one text
        plain = [w for w in fresh if w.isalpha() and max(w) < "\u0100"]
        for at in range(0, len(plain), BATCH_MISSES):
            part = plain[at:at + BATCH_MISSES]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):
                raise ValueError("this tokenizer does not mark the ends of words")
            for w, stop in zip(part, stops):
                young[w] = data[start:stop]
                start = stop
        other = [w for w in fresh if young[w] is None]
        for at in range(0, len(other), BATCH_MISSES):
            part = other[at:at + BATCH_MISSES]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                young[w] = np.array(e.ids, "<u4").tobytes()
        out = [np.frombuffer(b"".join(f if None not in f else map(young.__getitem__, w)), "<u4") for w, f in zip(words_of, found_of)]
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        return out


def _words(text: str) -> list[str]:
    """Runs whose ids do not depend on their neighbours: words between white space, a closing comma or stop set apart."""
    if SEPARATORS.search(text):
        return _split_exactly(text)
    try:
        text.encode("latin-1")
        text = text.lower()  # the same, letter by letter, as the tokenizer's own lower case
    except UnicodeEncodeError:
        pass
    if OTHER_MARK.search(text):
        return LAST_MARK.sub(r" \1", text).split()
    return text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " ,\n").replace(".\n", " .\n").split()


def _split_exactly(text: str) -> list[str]:
    """Words between Unicode white space; unlike str.split, the four separators 1C to 1F are part of words."""
    import regex

    return regex.findall(r"\S+", text)


_tokenizers: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def document_pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece, and ``ids`` (little-endian bytes) if asked for.

    A document's tokens are its ids and then END_ID, so even an empty or null text is one token. Repeated rows are
    documents of their own.
    """
    def run(batches):
        for pdf in batches:
            out = []
            texts = [t if isinstance(t, str) else "" for t in pdf.text]
            for at in range(0, len(texts), 32):
                for doc, ids in zip(pdf.doc_id[at:at + 32], _tokens(path).encode(texts[at:at + 32])):
                    data = ids.tobytes() + END_ID.to_bytes(4, "little")
                    for start in range(0, len(ids) + 1, SEQUENCE):
                        part = data[4 * start:4 * (start + SEQUENCE)]
                        out.append((doc, start, len(part) // 4, zlib.crc32(part), len(ids) + 1, part if with_ids else None))
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            yield made if with_ids else made.drop(columns="ids")

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of class sizes 1 to len(prices) that fits, by unbounded knapsack dynamic programming."""
    n = len(prices)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(n, room)
        total = value[room - 1::-1][:k] + prices[:k]
        best = int(total.argmax())
        if total[best] > value[room - 1] + 1e-12:
            value[room], choice[room] = total[best], best + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def pattern_counts(demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Whole-number patterns that hold at least ``demand[i]`` pieces of size i + 1, with how often each is used.

    The revised simplex keeps the inverse of the basis; it starts from patterns of one class each and stops when no
    knapsack is worth more than one sequence. Uses are rounded down; what is then left is packed first-fit by size.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    need = demand[sizes - 1].astype(float)
    m = len(sizes)
    each = capacity // sizes
    columns, inverse, amount = np.diag(each).astype(np.int64), np.diag(1.0 / each), need / each
    full = np.zeros(int(sizes[-1]))
    for _ in range(rounds):
        full[sizes - 1] = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, pattern = best_pattern(np.maximum(full, 0.0), capacity)
        if worth <= 1 + 1e-7:
            break
        enter = pattern[sizes - 1]
        direction = inverse @ enter
        ratios = np.where(direction > 1e-9, amount / np.maximum(direction, 1e-9), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        step = ratios[leave]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[leave] = step
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        columns[:, leave] = enter
    left = demand[sizes - 1].astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for j in range(m):
        uses = int(amount[j] + 1e-6)
        if uses:
            left -= columns[:, j] * uses
            out.append((_spread(columns[:, j], sizes, len(demand)), uses))
    while (left > 0).any():  # at most one more sequence per pattern, so this stays as small as the number of classes
        room, pattern = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            pattern[i] = min(max(left[i], 0), room // sizes[i])
            room -= pattern[i] * sizes[i]
        uses = max(1, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        left -= pattern * uses
        out.append((_spread(pattern, sizes, len(demand)), uses))
    return out


def _spread(pattern: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros(n, np.int64)
    wide[sizes - 1] = pattern
    return wide


def pack(pieces: DataFrame, capacity: int = SEQUENCE, grid: int = GRID_TOKENS) -> DataFrame:
    """``pieces`` (a saved table) with ``sequence_id`` and a gapless ``offset``; every sequence holds at most ``capacity``.

    Full pieces are sequences of their own. Equal lengths are ranked by doc_id, start and offset of the row's hash; an empty
    table gives no rows.
    """
    spark = pieces.sparkSession
    whole = F.col("length") == capacity
    rests = pieces.where(~whole).withColumn("class", F.ceil(F.col("length") / grid).cast("int"))
    salts = salts_for(pieces.count())
    rests = rests.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    per_share = saved(rests.groupBy("class", "share").count(), "shares")
    units = capacity // grid
    demand = np.zeros(units, np.int64)
    for row in per_share.groupBy("class").agg(F.sum("count").alias("n")).collect():
        demand[row["class"] - 1] = row["n"]
    # which ranks of a class go to which pattern: one row per pattern and class
    slots, sequence, used = [], 0, np.zeros(units, np.int64)
    for pattern, uses in pattern_counts(demand, units):
        for i in np.flatnonzero(pattern):
            slots.append((int(i) + 1, int(used[i]), int(used[i] + pattern[i] * uses), int(pattern[i]), sequence))
            used[i] += pattern[i] * uses
        sequence += uses
    base = per_share.withColumn("before", F.coalesce(F.sum("count").over(
        Window.partitionBy("class").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rests.withColumn("own", F.row_number().over(Window.partitionBy("class", "share").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(base.select("class", "share", "before")), ["class", "share"]).withColumn("rank", F.col("own") + F.col("before"))
    table = spark.createDataFrame(slots, "class int, low long, high long, per long, first long")
    by_class = table.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("low", "high", "per", "first"))).alias("slots"))
    spot = F.filter("slots", lambda s: (F.col("rank") >= s["low"]) & (F.col("rank") < s["high"]))[0]
    placed = ranked.join(F.broadcast(by_class), "class").withColumn("spot", spot).withColumn(
        "sequence_id", (F.col("spot.first") + F.floor((F.col("rank") - F.col("spot.low")) / F.col("spot.per"))).cast("long"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "rank")
                                  .rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(before, F.lit(0)))
    # whole pieces are numbered after all others, share by share
    full = pieces.where(whole).withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = saved(full.groupBy("share").count(), "full-shares")
    ahead = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumn("own", F.row_number().over(Window.partitionBy("share").orderBy("doc_id", "start", "ids_crc32")) - 1)
    full = full.join(F.broadcast(ahead.select("share", "before")), "share").withColumn(
        "sequence_id", (F.lit(sequence) + F.col("before") + F.col("own")).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    columns = [*pieces.columns, "sequence_id", "offset"]
    return placed.select(*columns).unionByName(full.select(*columns))


def pack_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed. ``with_ids`` adds each piece's tokens for writing sequences."""
    return pack(saved(document_pieces(docs, path, with_ids), "pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (little-endian bytes, at most a sequence each) from packed pieces that carry their ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(rows, lambda r: r["ids"]).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p)).alias("ids"))
