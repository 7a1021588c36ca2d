"""Quality rules whose cutoffs are certified on labelled holdouts: exact binomial bounds on false rejection, with a
correction for every hypothesis tested.

Each rule is a measure of the text; a text beyond the rule's cutoff is rejected. For every stratum and rule the strictest
grid cutoff is taken at which the upper confidence bound on the share of good holdout texts that it would reject stays
below the allowed risk. Bounds are Clopper-Pearson at level ``alpha`` divided by all strata and rules (Bonferroni) and tested
in fixed order along a rule's grid, so all cutoffs hold together. A stratum without enough labels rejects nothing by the method.
"""
from __future__ import annotations

from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_frames, saved
from .words import SPACE, window_hashes, word_hashes

MIN_WORDS, REPEAT_PART = 50, 50
#: The symbols that count.
SYMBOLS = b"#*$%&|<>"
#: Strata by language, fixed; every other language, and none, is the last one.
LANGUAGES = ("en", "de", "fr", "es")
STRATA = (*LANGUAGES, "other")
GRID = 64
RISK, ALPHA = 0.02, 0.05
#: Rules, each with the value of its last grid step; a measure is high for bad texts.
RULES = {"symbols_per_word": 4.0, "duplicate_line_part": 1.0, "repeated_word_part": 1.0, "capital_part": 1.0,
         "long_word": 16.0, "short_word": 1.0}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_lines", "n_capitals"]
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


def measure(text: str) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals`` of a whole text."""
    data = text.encode()
    b = np.frombuffer(data, np.uint8)
    words = word_hashes(data)
    chars = int((((b & 0xC0) != 0x80) & ~SPACE[b]).sum())
    windows = window_hashes(words, 3)
    repeated = np.zeros(len(words), bool)
    if len(windows):
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        for i in range(3):
            repeated[i:i + len(windows)] |= again
    seen, lines, duplicates = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return (len(words), chars, int(IS_SYMBOL[b].sum()), duplicates, int(repeated.sum()), lines, int(((b > 64) & (b < 91)).sum()))


def _measures(batches):
    for pdf in batches:
        rows = [measure(t if isinstance(t, str) else "") for t in pdf.pop("text")]
        yield pdf.reset_index(drop=True).join(pd.DataFrame(rows, columns=MEASURES))


def stratum_of(docs: DataFrame) -> F.Column:
    return F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other") if "lang" in docs.columns else F.lit("other")


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and the measures of every text; null texts have no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum_of(docs).alias("stratum"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{c} long" for c in MEASURES)
    return map_frames(rows, _measures, f"doc_id long, stratum string, {fields}")


def base_failed(prefix: str = "") -> F.Column:
    words = F.col(f"{prefix}n_words")
    return (words < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > REPEAT_PART * words)


def steps(prefix: str = "") -> F.Column:
    """Grid step of every rule, 0 to GRID - 1, as an array in the order of RULES."""
    def part(a, b):
        return F.when(F.col(prefix + b) > 0, F.col(prefix + a) / F.col(prefix + b)).otherwise(0.0)

    mean = part("word_chars", "n_words")
    values = (part("n_symbols", "n_words"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"),
              part("n_capitals", "word_chars"), mean, F.when(mean > 0, 1 / mean).otherwise(1.0))
    return F.array(*(F.least(F.floor(v / top * GRID), F.lit(GRID - 1)).cast("int") for v, top in zip(values, RULES.values())))


def upper_bound(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest chance p with P(Binomial(n, p) <= bad) >= level."""
    if bad >= n:
        return 1.0

    def below(p: float) -> float:
        terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(bad + 1)]
        top = max(terms)
        return exp(top) * sum(exp(t - top) for t in terms)

    low, high = bad / n, 1.0 - 1e-12
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if below(max(middle, 1e-300)) >= level else (low, middle)
    return high


def most_rejections(n: int, risk: float, level: float) -> int:
    """Most rejected good texts out of ``n`` at which the bound still holds; -1 if none does."""
    low, high = -1, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if upper_bound(middle, n, level) <= risk else (low, middle)
    return low


def certified_cutoffs(counts: dict[str, np.ndarray], risk: float = RISK, alpha: float = ALPHA) -> dict[str, list[int]]:
    """Grid steps from which on each rule rejects, per stratum. ``counts[stratum][rule, step]`` are good holdout texts.

    The texts that a cutoff rejects are among those of the next stricter one, so the steps of a rule are tested in a fixed order, from
    the loosest on, each at the rule's full level, up to the first that fails: the chance of a false certificate among them is that level. Bonferroni only
    divides it between strata and rules. With no good text rejected that takes about 1,900 labelled good texts in a stratum; a stratum with fewer has
    no cutoff and rejects nothing.
    """
    level = alpha / (len(STRATA) * len(RULES))
    out = {}
    for stratum in STRATA:
        table = counts.get(stratum, np.zeros((len(RULES), GRID), np.int64))
        n = int(table[0].sum())
        allowed = most_rejections(n, risk / len(RULES), level) if n else -1
        beyond = table[:, ::-1].cumsum(axis=1)[:, ::-1]  # rejected if the cutoff is this step
        out[stratum] = [next((s for s in range(GRID) if row[s] <= allowed), GRID) for row in beyond]
    return out


def fit(measured: DataFrame, labels: DataFrame) -> dict[str, list[int]]:
    """Cutoffs from the labelled texts that pass the base rules. Only STRATA x RULES x GRID counts reach the driver.

    A doc_id with several labels counts as good if one of them is 1; null labels are left out.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = measured.where(~base_failed()).join(good, "doc_id", "left_semi").select("stratum", F.posexplode(steps()).alias("rule", "step"))
    counts = {s: np.zeros((len(RULES), GRID), np.int64) for s in STRATA}
    for row in rows.groupBy("stratum", "rule", "step").count().collect():
        counts[row["stratum"]][row["rule"], row["step"]] = row["count"]
    return certified_cutoffs(counts)


def verdict(cutoffs: dict[str, list[int]], stratum, prefix: str = "") -> F.Column:
    """False where some rule's step is at or beyond the stratum's cutoff."""
    beyond = F.lit(False)
    for name, limits in cutoffs.items():
        hit = F.exists(F.zip_with(steps(prefix), F.array(*(F.lit(x) for x in limits)), lambda s, x: s >= x), lambda y: y)
        beyond = beyond | ((stratum == name) & hit)
    return ~beyond


def judge(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures with ``base_failed`` and ``kept``. Repeated rows are judged each for itself; empty tables give no rows."""
    found = measured.withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & verdict(fit(measured, labels), F.col("stratum")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rejected rows, same columns. Texts are measured twice, to fit and to filter, and never shuffled."""
    cutoffs = fit(saved(measures(docs), "measures"), labels)
    prefix = "m_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names, schema = [prefix + c for c in MEASURES], T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, T.LongType()) for c in MEASURES)])

    def run(batches):
        for pdf in batches:
            rows = [measure(t if isinstance(t, str) else "") for t in pdf["text"]]
            yield pdf.reset_index(drop=True).join(pd.DataFrame(rows, columns=names))

    kept = ~base_failed(prefix) & verdict(cutoffs, stratum_of(docs), prefix)
    return map_frames(docs, run, schema).where(kept).select(*docs.columns)
