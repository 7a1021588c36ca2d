"""Prefix trie, periodic runs and license scans against brute force and against the registered SQL."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waymesh.llm import licenses, periodic, trie

BIG = (1 << 53) + 1
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_periodic_runs", "op13_license_scan"])
def test_registered_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    names = [d[0] for d in cursor.description]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([dict(zip(names, r))[c] for c in columns]) for r in cursor.fetchall())


# -- prefix trie ------------------------------------------------------------------------------------------------------------------------------------

def slow_trie(rows, regraft):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in turns.items()}
    if regraft:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in turns.items()}
    nodes = defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, spared = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(SPACE_WORDS.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        spared[p] = own + sum(spared[q] for q in children[p])
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], spared[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if turns[c] == list(p)))).encode()).hexdigest()) for p, m in nodes.items())


def told(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("width,shard_rows", [(32, 50_000), (2, 7), (3, 40)])
def test_trie_equals_brute_force(spark, width, shard_rows):
    rng = random.Random(width)
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", None, "d  e f"]) if t else "hello there"))
    rows += [(c, t, "user", f"x {t}") for c in (500, 501, 502 + BIG) for t in range(40)]  # very long and equal ones
    rows += [(600, None, None, None), (600, 1, None, "z"), (600, 1, None, "z"), (600, 1, "user", "z"), (None, 1, "user", "q")]
    df = spark.createDataFrame(rows, CONV).withColumn("pos", F.lit("clash")).withColumn("words", F.lit(1))
    turns = trie.numbered_turns(df)
    ids = turns.select("conv_id").distinct()
    assert told(trie.prefix_trie(turns, ids, width, shard_rows)) == sorted(slow_trie(rows, False), key=str)
    assert told(trie.prefix_trie(*trie.regrafted(turns), width, shard_rows)) == sorted(slow_trie(rows, True), key=str)


def test_trie_of_nothing_and_of_one_crowd(spark):
    assert trie.prefix_trie(*trie.regrafted(trie.numbered_turns(spark.createDataFrame([], CONV)))).count() == 0
    rows = [(c, t, "user", f"{t}") for c in range(300) for t in range(3)]  # one sequence that all share
    turns = trie.numbered_turns(spark.createDataFrame(rows, CONV))
    assert told(trie.prefix_trie(turns, turns.select("conv_id"))) == sorted(slow_trie(rows, False), key=str)


# -- periodic runs ----------------------------------------------------------------------------------------------------------------------------------

def slow_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if j > i and size >= max(6, 4 * q) and not any(q % d == 0 and all(w[k] == w[k - d] for k in range(s + d, s + size)) for d in range(1, q)):
                out.append((s, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            k = rng.choice([1, 2, 3])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
            base = [rng.randrange(k + 1) for _ in range(rng.randint(1, 6))]
            texts.append(w[:rng.randint(0, 8)] + base * rng.randint(0, 8) + w)
        got = periodic.runs_of_texts([periodic.mix(np.array(w, np.uint64) + np.uint64(1)) for w in texts])
        assert [[tuple(map(int, r)) for r in g] for g in got] == [slow_runs(w) for w in texts]


def test_long_stretches_and_tree_groups(monkeypatch):
    rng = random.Random(8)
    texts = [[rng.randrange(2) for _ in range(400)] for _ in range(6)] + [[7] * 3000, [1, 2, 3] * 500]
    hashes = [periodic.mix(np.array(w, np.uint64) + np.uint64(1)) for w in texts]
    whole = periodic.runs_of_texts(hashes)
    monkeypatch.setattr(periodic, "TREE_WORDS", 100)
    assert all((a == b).all() for a, b in zip(whole, periodic.runs_of_texts(hashes)))
    assert whole[6].tolist() == [[0, 3000, 1]] and whole[7].tolist() == [[0, 1500, 3]]
    assert [list(map(tuple, g.tolist())) for g in whole[:6]] == [slow_runs(w) for w in texts[:6]]


def test_run_query_equals_brute_force(spark, docs, monkeypatch):
    rng = random.Random(7)
    rows = [(None, "a b " * 9), (None, "x"), (0, None), (1, ""), (2, " \t\n"), (3, "only"), (BIG, "la " * 50), (4, "é\x1c b\x0b" * 12)]
    rows += [(i, " ".join(rng.choice(["a", "b", "c d", "\n"]) for _ in range(rng.randint(0, 90)))) for i in range(10, 90)] + [(12, "p q r s " * 5)] * 3

    def slow(doc, text):
        w = SPACE_WORDS.findall(text or "")
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = slow_runs(w)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        return (doc, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
                hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())

    df = docs(rows).withColumn("runs", F.lit(1)).withColumn("_w", F.lit(2))
    got = periodic.digests(periodic.find_runs(periodic.made_periodic(df)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(slow(*r)) for r in rows)
    assert periodic.find_runs(docs(rows).limit(0)).count() == 0
    assert {r.text for r in periodic.collapse(docs([(5, "a b " * 9)])).collect()} == {"a b"}


def test_collapse_in_blocks(monkeypatch):
    text = ("one two " * 40 + "tail").encode()
    runs = periodic.runs_of_texts([periodic.word_hashes(text)])[0]
    whole = periodic.collapsed(text, 81, runs)
    monkeypatch.setattr(periodic, "BLOCK", 16)
    assert periodic.collapsed(text, 81, runs) == whole == b"one two tail"


# -- license scans ----------------------------------------------------------------------------------------------------------------------------------

def slow_scan(text, templates, threshold):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(label, i) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found = {}
    for at in range(0, max(0, -(-(len(w) - licenses.BLOCK_WORDS) // licenses.STEP)) * licenses.STEP + 1, licenses.STEP):
        block = set(w[at:at + licenses.BLOCK_WORDS])
        for name, t in templates.items():
            words = {x.decode() for x in licenses.words_of(t.encode())}
            if len(words & block) >= licenses.needed(len(words), threshold):
                label = name.partition("/")[0]
                found[label] = max(found.get(label, 0), len(words & block) / len(words))
    labels = {x for x, _ in base}
    return (len(w), len(base), min((i for _, i in base), default=None), max((i for _, i in base), default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))),
            1.0 if base else max(found.values(), default=0.0))


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_scan_equals_brute_force(spark, docs, threshold):
    rng = random.Random(9)
    pool = [w.decode() for t in licenses.TEMPLATES.values() for w in licenses.words_of(t.encode())] + ["und", "die", "x1", "CC", "BY", "é"]
    rows = [(None, "CC-BY 4.0"), (0, None), (1, ""), (2, "cc by cc by"), (BIG, "All Rights\nReserved. the GNU GENERAL public license"), (3, "word " * 3000 + licenses.TEMPLATES["mit/grant"])]
    for i in range(150):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            t = rng.choice(list(licenses.TEMPLATES.values())).split()
            del t[rng.randrange(len(t))]
            at = rng.randint(0, len(words))
            words[at:at] = t
        rows.append((100 + i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [rows[10]] * 3
    got = licenses.digests(licenses.scan(docs(rows).withColumn("labels", F.lit(1)).withColumn("places", F.lit(2)), threshold=threshold))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *slow_scan(t, licenses.TEMPLATES, threshold))) for i, t in rows)
    assert licenses.scan(docs(rows).limit(0)).count() == 0


def test_scan_labels_what_base_phrases_miss(docs):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "mit und in der die"), (4, "Licensed under CC BY-NC 4.0.")]
    assert [r.labels for r in licenses.digests(licenses.scan(docs(rows))).orderBy("doc_id").collect()] == ["apache-2.0", "mit", "", "cc-by,cc-by-nc"]
