"""Personal data: exact forms first, then bootstrapped contextual extraction.

Matches of the exact forms are seeds. The words before and behind a seed are its lexical patterns. Looser forms of the same kinds are
candidate instances; they stand in the same pattern-instance graph, which Spark scores in rounds: a pattern is as sure as
the share of all its occurrences in the corpus that hold a likely instance, an instance is as sure as its patterns
together. Instances of sure, well-supported patterns become spans; the exact ones always stay.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .shared import map_frames, saved
from .words import window_hashes, word_hashes

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms, whose kind the context decides.
LOOSE = {"email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63})*"),
         "ip": re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w.])"),
         "card": re.compile(r"(?<![\w.-])[0-9]{4}(?:[\x20.-]?[0-9]{2,6}){2,5}(?![\w])"),
         "phone": re.compile(r"(?<![\w.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![\w])")}
LOOSE_DIGITS = {"card": (13, 19), "phone": (7, 15)}
SUPPORT, SURE_PATTERN, SURE_INSTANCE, ROUNDS = 5, 0.5, 0.9, 3
CONTEXT_CHARS = 200
PATTERNS = ("before_1", "before_2", "after_1", "after_2")
#: Patterns behind a place have keys of their own.
AFTER = 0x5DEECE66D1234567
MENTION = "kind string, seed boolean, start long, end long, instance long, before_1 long, before_2 long, after_1 long, after_2 long"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of ``local@domain.tld``, found from each ``@`` so that long runs cost linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def exact(text: str) -> list[tuple[str, int, int]]:
    """Exact spans by kind as listed, then start; per kind leftmost and not overlapping."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def loose(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that touch neither an exact one nor each other; the first kind listed wins."""
    used, out = sorted((a, b) for _, a, b in taken), []
    for kind in KINDS:
        if kind == "email" and "@" not in text and "at)" not in text and "at]" not in text:
            continue
        low, high = LOOSE_DIGITS.get(kind, (0, 1 << 30))
        found, at, end = [], 0, 0
        for m in LOOSE[kind].finditer(text):
            start, stop = m.span()
            while at < len(used) and used[at][0] < stop:  # the furthest end of all used spans that start before this one ends
                end = max(end, used[at][1])
                at += 1
            if end <= start and low <= sum(map(str.isdigit, m[0])) <= high:
                found.append((start, stop))
        out += [(kind, *span) for span in found]
        used = sorted(used + found)
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode(), digest_size=8).digest(), "little", signed=True)


def _patterns(text: str, start: int, end: int) -> list[int | None]:
    """Keys of the one and two words before a place and behind it."""
    before, after = _words_before(text, start)[-2:], _words_after(text, end)[:2]
    keys: list[int | None] = []
    for words, mark in ((before, 0), (after, AFTER)):
        for k in (1, 2):
            part = words[-k:] if mark == 0 else words[:k]
            keys.append(int(window_hashes(part, k).view(np.int64)[0]) ^ mark if len(part) == k else None)
    return keys


def _words_before(text: str, start: int) -> np.ndarray:
    """At least the two last words before a place, none of them cut."""
    size = CONTEXT_CHARS
    while True:
        low = max(0, start - size)
        words = word_hashes(text[low:start].encode(), lower=True)
        if not low or len(words) > 2:
            return words
        size *= 4


def _words_after(text: str, end: int) -> np.ndarray:
    size = CONTEXT_CHARS
    while True:
        high = min(len(text), end + size)
        words = word_hashes(text[end:high].encode(), lower=True)
        if high == len(text) or len(words) > 2:
            return words
        size *= 4


def _find(batches):
    for pdf in batches:
        out = []
        for doc, digest, text in zip(pdf.doc_id, pdf.digest, pdf.text):
            text = text if isinstance(text, str) else ""
            spans = exact(text)
            more = loose(text, spans) if DIGIT_OR_AT.search(text) else []
            told = [(k, s, a, b, _hash(text[a:b]), *_patterns(text, a, b)) for s, found in ((True, spans), (False, more)) for k, a, b in found]
            out.append((doc, digest, [dict(zip(("kind", "seed", "start", "end", "instance", *PATTERNS), t)) for t in told]))
        yield pd.DataFrame(out, columns=["doc_id", "digest", "mentions"])


DIGIT_OR_AT = re.compile(r"[0-9@]|\(at\)|\[at\]")


def _occurrences(keys: np.ndarray):
    def run(batches):
        for pdf in batches:
            total = np.zeros(len(keys), np.int64)
            for text in pdf.text:
                if isinstance(text, str) and text:
                    words = word_hashes(text.encode(), lower=True)
                    for k in (1, 2):
                        for mark in (0, AFTER):
                            seen = window_hashes(words, k).view(np.int64) ^ mark
                            spot = np.searchsorted(keys, seen)
                            hit = spot[keys[np.minimum(spot, len(keys) - 1)] == seen]
                            total += np.bincount(hit, minlength=len(keys))
            yield pd.DataFrame({"pattern": keys, "n": total})[total > 0]

    return run


def _accepted(docs: DataFrame, mentions: DataFrame) -> DataFrame | None:
    """``kind, instance`` of looser instances that the pattern graph is sure of; None if no pattern ties one to enough others.

    Patterns with SUPPORT different instances are in the graph. In every round a pattern counts once SUPPORT of its instances are seeds or
    accepted by then, so instances found in one round support patterns in the next that no seed stands by.
    """
    edges = mentions.select("kind", "instance", "seed", F.explode(F.array(*PATTERNS)).alias("pattern")).where(F.col("pattern").isNotNull())
    edges = cut(edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    support = edges.groupBy("kind", "pattern").agg(F.count("*").alias("all_n"), F.count_if("seed").alias("seeds"))
    wanted = cut(support.where((F.col("all_n") >= SUPPORT) & (F.col("all_n") > F.col("seeds"))).select("kind", "pattern"))
    if wanted.isEmpty() or support.where(F.col("seeds") >= SUPPORT).isEmpty():
        return None
    edges = cut(edges.join(wanted, ["kind", "pattern"]))
    patterns = wanted.select("pattern").distinct()
    if patterns.count() <= 1_000_000:  # eight bytes each
        keys = np.sort(np.array([r[0] for r in patterns.collect()], np.int64))
        counted = docs.select("text").mapInPandas(_occurrences(keys), "pattern long, n long")
    else:
        counted = docs.select("text").mapInPandas(_all_patterns, "pattern long, n long").join(patterns, "pattern", "left_semi")
    occurrences = cut(counted.groupBy("pattern").agg(F.sum("n").alias("occurrences")))
    scores = edges.select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score")).groupBy("kind", "instance").agg(F.max("score").alias("score"))
    for _ in range(ROUNDS):
        held = edges.join(scores, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            F.sum(F.col("score") * F.col("n")).alias("held"), F.sum("n").alias("all_n"), F.count_if(F.col("score") >= SURE_INSTANCE).alias("support"))
        sure = held.where(F.col("support") >= SUPPORT).join(occurrences, "pattern", "left").select("kind", "pattern", (
            F.col("held") / (F.greatest("all_n", F.coalesce("occurrences", F.lit(0))) + 1)).alias("sure")).where(F.col("sure") >= SURE_PATTERN)
        told = edges.join(sure, ["kind", "pattern"], "left").groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("sure", F.lit(0.0)), F.lit(1e-9)))))).alias("told"), F.max("seed").alias("seed"))
        scores = cut(told.select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("told")).alias("score")))
    loose_ones = edges.where(~F.col("seed")).select("kind", "instance").distinct()
    return scores.where(F.col("score") >= SURE_INSTANCE).select("kind", "instance").join(loose_ones, ["kind", "instance"], "left_semi")


def _all_patterns(batches):
    for pdf in batches:
        found = [window_hashes(word_hashes(t.encode(), lower=True), k).view(np.int64) ^ mark for t in pdf.text if isinstance(t, str) for k in (1, 2) for mark in (0, AFTER)]
        keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        yield pd.DataFrame({"pattern": keys, "n": n})


SPANS = "array<struct<kind:string,seed:boolean,start:long,end:long>>"


COPIES = 16


def _mentions(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """All mentions per row of ``docs`` (``doc_id, text``) with the text's digest, and per digest its accepted looser ones (None: there are none)."""
    rows = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    found = saved(map_frames(rows, _find, f"doc_id long, digest string, mentions array<struct<{', '.join(f'{a}:{b}' for a, b in (m.split() for m in MENTION.split(', ')))}>>"), "mentions")
    accepted = _accepted(docs, found.select(F.explode("mentions").alias("m")).select("m.*"))
    if accepted is None:
        return found, None
    # equal texts have equal mentions: one row of each digest stands for all
    each = found.where(F.exists("mentions", lambda m: ~m["seed"])).select("digest", F.explode("mentions").alias("m")).where(~F.col("m.seed")).select(
        "digest", "m.kind", "m.start", "m.end", "m.instance").distinct()
    sure = each.join(accepted, ["kind", "instance"], "left_semi").groupBy("digest").agg(F.collect_list(F.struct("kind", F.lit(False).alias("seed"), "start", "end")).alias("more"))
    return found, saved(sure.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))), "accepted")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (kind, seed, start, end in code points; exact ones have ``seed``) of every whole text.

    Null and empty texts have no spans. Rows with null or repeated ids come out once each. Spans are listed by kind, then start.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, sure = _mentions(docs)
    seeds = F.transform(F.filter("mentions", lambda m: m["seed"]), _span)
    if sure is None:
        return found.select("doc_id", _listed(seeds).alias("spans"))
    # the accepted ones of a text lie in COPIES shares, so a text that very many rows have is spread
    share = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(COPIES)).cast("int")
    return found.withColumn("copy", share).join(sure, ["digest", "copy"], "left").select(
        "doc_id", _listed(F.concat(seeds, F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def _span(m):
    return F.struct(m["kind"].alias("kind"), m["seed"].alias("seed"), m["start"].alias("start"), m["end"].alias("end"))


def _listed(mentions):
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(mentions, lambda m: F.struct(order[m["kind"]].alias("order"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["seed"].alias("seed")))
    return F.transform(F.array_sort(keyed), lambda m: F.struct(m["kind"].alias("kind"), m["seed"].alias("seed"), m["start"].alias("start"), m["end"].alias("end")))


def told(spans) -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the union goes. Other columns stay.

    Every row is redacted by what its own text holds, whatever its doc_id: exact spans are found where the text is, accepted looser ones
    come by the text's digest. ``n_chars``, where present, is counted anew. Null texts stay null.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, sure = _mentions(plain)
    columns = docs.columns
    extra = "more"
    while extra in columns:
        extra = f"_{extra}"
    none = F.lit(None).cast(SPANS)
    if sure is None:
        rows = docs.withColumn(extra, none)
    else:
        digest, copy = f"{extra}_digest", f"{extra}_copy"
        given = docs.withColumns({digest: F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), copy: F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int")})
        rows = given.join(sure.select(F.col("digest").alias(digest), F.col("copy").alias(copy), F.col("more").alias(extra)), [digest, copy], "left").select(*columns, extra)

    def run(batches):
        for pdf in batches:
            texts = [_replaced(t, exact(t) + [(m["kind"], m["start"], m["end"]) for m in (more if more is not None else ())]) if isinstance(t, str) else None
                     for t, more in zip(pdf.text, pdf[extra])]
            yield pdf.assign(text=texts)[columns]

    out = map_frames(rows, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end > at:
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = end
    return "".join([*out, text[at:]])
