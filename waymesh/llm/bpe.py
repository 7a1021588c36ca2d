"""Byte-level BPE in linear time: longest vocabulary matches, taken back where two neighbours could not stand side by side.

Bytes are mapped to Latin-1 characters, so that one automaton over the vocabulary gives for each position the longest
token that ends there. A piece's encoding is the only sequence whose neighbours are all compatible, that is, whose
concatenation encodes to just these two tokens. Longest matches are tried first; a position from which nothing
compatible follows is marked dead, so each is left at most once.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_frames

CACHE_PIECES = 300_000
CACHE_PAIRS = 500_000


class Encoder:
    """Encodes pieces by a file of ranks. Memory is bounded: the caches hold a fixed number of entries."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.rank_of = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text_of = {rank: text for text, rank in self.rank_of.items()}
        self.matcher = ahocorasick.Automaton()
        for text, rank in self.rank_of.items():
            self.matcher.add_word(text, rank)
        self.matcher.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.size_of = {rank: len(text) for rank, text in self.text_of.items()}
        self.pairs: dict[int, bool] = {}
        self.widest = max(self.size_of.values())
        self.prefix_of: dict[int, int | None] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one: the split with all parts intact under lower ranks."""
        if token not in self.halves:
            text, found = self.text_of[token], None
            if len(text) > 1:
                parts = self._merge(text, token)
                found = (parts[0], parts[1]) if len(parts) == 2 else None
            self.halves[token] = found
        return self.halves[token]

    def _merge(self, text: str, limit: int) -> list[int]:
        """Plain merging of a short text by ranks below ``limit``."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank_of.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= limit:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.rank_of[p] for p in parts]

    def border(self, token: int, right: bool) -> list[tuple[str, int]]:
        """The parts of a token that touch its right (or left) border, outermost first, each with the rank that ends it."""
        spines = self.spines[right]
        found = spines.get(token)
        if found is None:
            found, part, ends = [], token, 1 << 31
            while part is not None:
                found.append((self.text_of[part], ends))
                halves = self.split(part)
                ends, part = part, halves[right] if halves else None
            spines[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge across their border comes before those that used the parts up.

        Of two merges of equal rank the left one comes first.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            rank_of, known = self.rank_of, True
            for x, x_ends in self.border(left, True):
                for y, y_ends in self.border(right, False):
                    rank = rank_of.get(x + y)
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, given in Latin-1."""
        whole = self.rank_of.get(text)
        if whole is not None:
            return (whole,)
        greedy, pairs, n = [token for _, token in self.matcher.iter_long(text)], self.pairs, len(text)
        if all(pairs.get(a << 20 | b) or self.compatible(a, b) for a, b in zip(greedy, greedy[1:])) and sum(map(self.size_of.__getitem__, greedy)) == n:
            return tuple(greedy)
        dead = bytearray(n + 1)  # positions from which no compatible continuation was found
        ids: list[int] = []
        at, token = 0, greedy[0]
        while True:
            size = self.size_of[token]
            if not dead[at + size] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at += size
                if at == n:
                    return tuple(ids)
                token = self.longest(text, at)
                continue
            token = self.shorter(token)
            while token is None:  # nothing fits here: this position is dead for good, go back one token
                dead[at] = 1
                last = ids.pop()
                at -= self.size_of[last]
                token = self.shorter(last)

    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a position; the automaton's trie gives how far any token can reach."""
        reach = self.matcher.longest_prefix(text[at:at + self.widest])
        found = self.rank_of.get(text[at:at + reach])
        while found is None:
            reach -= 1
            found = self.rank_of.get(text[at:at + reach])
        return found

    def shorter(self, token: int) -> int | None:
        """The next shorter vocabulary prefix of a token."""
        if token not in self.prefix_of:
            text = self.text_of[token]
            self.prefix_of[token] = next((self.rank_of[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.rank_of), None)
        return self.prefix_of[token]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, match of the pattern by match. What was used of late is looked up, in two generations of pieces."""
        young, old, out = self.young, self.old, []
        for piece in self.find(text):
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece) or self.piece(piece.encode().decode("latin-1"))
                if len(piece) <= 64:
                    if len(young) >= CACHE_PIECES:
                        self.old, self.young = young, {}
                        young, old = self.young, young
                    young[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The task's encoder, made once per Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text; null is the empty text, which has no ids."""
    def run(batches):
        enc = encoder(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "ids": [enc.encode(t) if isinstance(t, str) else [] for t in pdf.text]})

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids never leave the task that made them."""
    def run(batches):
        enc = encoder(path, pattern)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = enc.encode(text) if isinstance(text, str) else []
                out.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_frames(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
