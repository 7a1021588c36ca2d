"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

Texts fall into overlapping blocks of words, so every stretch of half a block lies whole in one. A block and a template are
joined when the block holds at least THRESHOLD of the template's distinct words. Words are ordered by the number of texts of the
corpus that hold them, rarest first, which Spark counts over all documents. A template can only reach the
threshold in blocks that hold one of its few rarest words (prefix filter), that have enough words (length filter), and where
enough words are left behind the first match on either side (positional filter); what is left is compared exactly. Templates are
a parameter of bounded size, so they are sent to every task and texts are never shuffled.
"""
from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template sentences, from the public texts of the licenses; several may share a label before the slash.
TEMPLATES = {
    "mit/name": "released under the MIT license",
    "mit/licensed": "licensed under the MIT license",
    "mit/grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2.0/name": "licensed under the Apache License version 2.0",
    "apache-2.0/notice": "you may not use this file except in compliance with the License you may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
    "bsd/grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd/name": "licensed under the BSD license",
    "gpl/notice": "this program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl/name": "this work is licensed under the GNU General Public License version",
    "lgpl/notice": "this library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0/notice": "this source code form is subject to the terms of the Mozilla Public License v 2.0",
    "isc/grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense/notice": "this is free and unencumbered software released into the public domain",
    "cc-by/notice": "this work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc/name": "licensed under CC BY NC",
    "cc-by-nc/notice": "this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-sa/name": "licensed under CC BY SA",
    "cc0/notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "warranty/notice": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose",
}
THRESHOLD = 0.85
BLOCK_WORDS, STEP = 64, 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: On UTF-8 bytes the same as ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text: every byte of another character is 128 or more.
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("base", pa.bool_())]))),
                 ("score", pa.float64())])
DDL = "doc_id long, n_words long, places array<struct<label:string,start:long,base:boolean>>, score double"


def words_of(data: bytes) -> list[bytes]:
    return WORD.findall(data.translate(LOWER))


def needed(size: int, threshold: float) -> int:
    """Fewest words of a template of ``size`` distinct ones that reach the threshold."""
    return max(1, int(np.ceil(threshold * size - 1e-9)))


def word_counts(docs: DataFrame, templates: Mapping[str, str]) -> dict[bytes, int]:
    """In how many texts each word of the templates stands, over all documents; one short row per word reaches the driver."""
    vocabulary = sorted({w for t in templates.values() for w in words_of(t.encode())})
    number = {w: i for i, w in enumerate(vocabulary)}

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                held = number.keys() & set(words_of(text or b""))
                total[[number[w] for w in held]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held = {r["word"]: r["n"] for r in rows}
    return {w: held.get(i, 0) for i, w in enumerate(vocabulary)}


class Join:
    """The join of one text's blocks with all templates, by prefix, length and position."""

    def __init__(self, templates: Mapping[str, str], counts: Mapping[bytes, int], threshold: float = THRESHOLD):
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates, self.by_prefix = [], {}
        for name, text in sorted(templates.items()):
            ranks = sorted({self.rank[w] for w in words_of(text.encode())})
            if not ranks:
                continue
            least = needed(len(ranks), threshold)
            number = len(self.templates)
            self.templates.append((name.partition("/")[0], ranks, frozenset(ranks), least))
            for at, r in enumerate(ranks[:len(ranks) - least + 1]):
                self.by_prefix.setdefault(r, []).append((number, at))

    def blocks(self, words: list[bytes]):
        """Start and sorted distinct ranks of every block that holds a word of some template's prefix."""
        known = [(i, r) for i, r in enumerate(map(self.rank.get, words)) if r is not None]
        wanted = sorted({b for i, r in known if r in self.by_prefix for b in self.around(i, len(words))})
        at = 0
        for b in wanted:
            while at < len(known) and known[at][0] < b * STEP:
                at += 1
            end = at
            while end < len(known) and known[end][0] < b * STEP + BLOCK_WORDS:
                end += 1
            yield b * STEP, sorted({r for _, r in known[at:end]})

    @staticmethod
    def around(i: int, n: int) -> range:
        """Numbers of the blocks that hold word ``i`` of ``n``: block b has the words from b * STEP on, and the last one ends the text."""
        last = max(0, -(-(n - BLOCK_WORDS) // STEP))
        return range(max(0, -(-(i - BLOCK_WORDS + 1) // STEP)), min(last, i // STEP) + 1)

    def __call__(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """Label, block start and containment of every block and template that reach the threshold."""
        out = []
        for start, held in self.blocks(words):
            overlap: dict[int, int] = {}
            for b, r in enumerate(held):
                for number, a in self.by_prefix.get(r, ()):
                    _, ranks, _, least = self.templates[number]
                    if len(held) >= least:  # length filter; positional filter: what can still follow on both sides
                        so_far = overlap.get(number, 0)
                        overlap[number] = so_far + 1 if so_far >= 0 and so_far + 1 + min(len(ranks) - a, len(held) - b) - 1 >= least else -1
            here = set(held) if overlap else set()
            for number, shared in overlap.items():
                label, ranks, members, least = self.templates[number]
                if shared > 0 and (both := len(members & here)) >= least:
                    out.append((label, start, both / len(ranks)))
        return out


def base_places(words: list[bytes], phrases=tuple((tuple(p.encode().split()), label) for p, label in PHRASES.items())) -> list[tuple[str, int]]:
    """Label and first word of every place where a phrase's words stand in a row."""
    out = []
    for phrase, label in phrases:
        at, last = -1, len(phrase) - 1
        try:
            while True:
                at = words.index(phrase[last], at + 1)  # the last word of each phrase is the rarest in running text
                if at >= last and tuple(words[at - last:at + 1]) == phrase:
                    out.append((label, at - last))
        except ValueError:
            pass
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, places, score`` per row of ``docs`` (``doc_id, text``; other columns are ignored).

    ``places`` lists base phrases (``base``, first word) and blocks that reach a template's threshold (label, first word of the
    block), base ones first. ``score`` is 1 where a base phrase stands, else the greatest containment of a template in a block that reaches the
    threshold, else 0. Null and empty texts have no word. Rows with null or repeated ids come out once each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    join = Join(templates, word_counts(docs, templates), threshold)

    def run(batches):
        for batch in batches:
            sizes, places, scores = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                base, found = base_places(words), join(words)
                sizes.append(len(words))
                places.append([(label, at, True) for label, at in base] + [(label, at, False) for label, at, _ in found])
                scores.append(1.0 if base else max((c for _, _, c in found), default=0.0))
            rows = [[{"label": a, "start": b, "base": c} for a, b, c in p] for p in places]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, OUT.field("places").type), pa.array(scores, pa.float64())], schema=OUT)

    return docs.mapInArrow(run, DDL)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and labels of scanned documents: base places alone, and with the method's labels."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def listed(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                          listed(base).alias("base_labels"), listed("places").alias("labels"), "score")


def oracle(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The digests in SQL, block by block and template by template, without any filter."""
    rows = []
    for name, text in sorted(templates.items()):
        words = sorted({w.decode() for w in words_of(text.encode())})
        rows.append(f"('{name.partition('/')[0]}', {words!r}, {needed(len(words), threshold)})")
    phrases = " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, i - 1 AS spot FROM numbered WHERE " + " AND ".join(f"list_extract(w, i + {j}) = '{x}'" for j, x in enumerate(p.split()))
        for p, label in PHRASES.items())
    return rf"""
        WITH texts AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        numbered AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
        base AS ({phrases}),
        templates(label, t, least) AS (VALUES {', '.join(rows)}),
        blocks AS (SELECT k, w, unnest(range(0, greatest(0, (len(w) - {BLOCK_WORDS} + {STEP - 1}) // {STEP}) + 1)) * {STEP} AS spot FROM texts),
        windows AS (SELECT k, spot, list_slice(w, spot + 1, spot + {BLOCK_WORDS}) AS b FROM blocks),
        found AS (SELECT k, label, len(list_intersect(t, b)) / len(t) AS held FROM windows, templates WHERE len(list_intersect(t, b)) >= least),
        more AS (SELECT k, list(DISTINCT label) AS more, max(held) AS held FROM found GROUP BY k),
        counts AS (SELECT k, count(*) AS n, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY k)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, []::VARCHAR[])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []::VARCHAR[]), coalesce(more, []::VARCHAR[])))), ',') AS labels,
               CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(held, 0.0)::DOUBLE END AS score
        FROM texts LEFT JOIN counts USING (k) LEFT JOIN more USING (k)"""
