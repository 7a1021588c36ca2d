"""Quality verdicts, url verdicts and the whole pipeline against plain Python versions."""
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import __spark_entry__ as entry
import public_tokenizers as P
from test_llm import brute_components, slow_exact
from waymesh.llm import linktrust, pii, quality

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    words = WORDS.findall(text)
    spots = defaultdict(list)
    for i in range(len(words) - 2):
        spots[tuple(words[i:i + 3])].append(i)
    repeated = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(lines), len(re.findall("[A-Z]", text)))


def failed(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def slow_steps(m):
    words, chars, symbols, again, repeated, lines, capitals = m
    mean = chars / words if words else 0.0
    values = (symbols / words if words else 0.0, again / lines if lines else 0.0, repeated / words if words else 0.0, capitals / chars if chars else 0.0, mean, 1 / mean if mean else 1.0)
    return [min(int(v / top * 64), 63) for v, top in zip(values, (4.0, 1.0, 1.0, 1.0, 16.0, 1.0))]


def certified(bad, n):
    """Whether the exact upper bound on a share of which ``bad`` in ``n`` were seen is within the risk of a rule."""
    p = 0.02 / 6
    if bad > 40:  # six or seven would be the mean at this risk
        return False
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1)) <= 0.05 / 30


def slow_cutoffs(steps_of_good):
    n, out = len(steps_of_good), []
    for rule in range(6):
        cutoff = 64
        for s in range(63, -1, -1):  # from the loosest on, up to the first that fails
            if not n or not certified(sum(x[rule] >= s for x in steps_of_good), n):
                break
            cutoff = s
        out.append(cutoff)
    return out


def test_quality_equals_plain_version(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(2600):
        lang = "en" if i % 8 else rng.choice(["de", "xx", None])
        words = [rng.choice(vocabulary) for _ in range(rng.randint(52, 60))]
        good = rng.random() < 0.93
        if not good:
            k = rng.randrange(4)
            words = [w.upper() for w in words] if k == 0 else [w + "#*|" for w in words] if k == 1 else words + words[:20] if k == 2 else [w * 4 for w in words]
        rows.append((i, " ".join(words) + ("\n" + words[0]) * rng.randrange(3), lang, "s", 0))
        labels.append((i, int(good), 0))
    rows += [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "x " * 60, "de", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.judge(quality.measures(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    measured = {i: slow_measures(t or "") for i, t, *_ in rows}
    stratum = {i: lang if lang in ("en", "de", "fr", "es") else "other" for i, _, lang, *_ in rows}
    good = defaultdict(list)
    for i, q, _ in labels:
        if q and not failed(measured[i]):
            good[stratum[i]].append(slow_steps(measured[i]))
    cutoffs = {s: slow_cutoffs(good[s]) for s in ("en", "de", "fr", "es", "other")}
    for i, m in measured.items():
        kept = not failed(m) and not any(x >= c for x, c in zip(slow_steps(m), cutoffs[stratum[i]]))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed, got[i].kept) == (*m[:5], failed(m), kept), i
    assert sum(not failed(m) and not got[i].kept for i, m in measured.items()) > 50 and min(cutoffs["en"]) < 64 and cutoffs["de"] == [64] * 6


def slow_ranks(edges, seeds):
    score = {h: 1 / len(seeds) for h in seeds} if seeds else {}
    start = dict(score)
    for _ in range(linktrust.ROUNDS):
        fresh = defaultdict(float)
        for (a, b), w in edges.items():
            fresh[b] += 0.85 * w * score.get(a, 0.0)
        for h, m in start.items():
            fresh[h] += 0.15 * m
        score = fresh
    return score


def test_url_trust_equals_plain_pagerank(spark):
    rng = random.Random(22)
    hosts = [f"h{i}.net" for i in range(25)] + ["a.org", "b.org", "bad.com", "worse.com", "hub.net", "end.io"]
    rows = []
    for i in range(160):
        host = rng.choice(hosts)
        links = [rng.choice(hosts) for _ in range(rng.randrange(4))] + ["hub.net"] * (rng.random() < 0.3)
        links = [] if host == "end.io" else links
        path = "/de/x" if host in ("bad.com", "worse.com") else "/p"
        rows.append((i, f"http://{host}{path}", "".join(f'<a href="https://{x}/q">x</a>' for x in links)))
    got = {r.page_id: r.verdict for r in linktrust.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    scores = {r.host: (r.trust, r.distrust) for r in linktrust.host_scores(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    counts = Counter((re.match(r"http://([^/]*)", u)[1], x) for _, u, h in rows for x in re.findall(r"https://([^/]*)/q", h))
    counts = {k: n for k, n in counts.items() if k[0] != k[1]}
    out, seen = Counter(), {re.match(r"http://([^/]*)", u)[1] for _, u, _ in rows}
    for (a, _), n in counts.items():
        out[a] += n
    forward = {k: n / out[k[0]] for k, n in counts.items()}
    back = Counter()
    for (_, b), w in forward.items():
        back[b] += w
    trust = slow_ranks(forward, [h for h in seen if h.endswith(".org")])
    distrust = slow_ranks({(b, a): w / back[b] for (a, b), w in forward.items()}, [h for h in seen if h.endswith(".com")])
    for h in set(trust) | set(distrust):
        assert np.allclose(scores[h], (trust.get(h, 0.0), distrust.get(h, 0.0))), h
    for i, u, _ in rows:
        host = re.match(r"http://([^/]*)", u)[1]
        want = "block" if host.endswith(".com") else "allow" if host.endswith(".org") else "block" if distrust.get(host, 0) > trust.get(host, 0) else "allow"
        assert got[i] == want, (i, host)
    assert len({got[i] for i, u, _ in rows if ".net" in u}) == 2


def test_pipeline_equals_plain_version(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    good = [r for r in rows if not failed(slow_measures(r["text"] or ""))]  # far too few labels for a certified cutoff
    kept = {i for i, (_, _, stays) in brute_components([(r["doc_id"], r["text"]) for r in good]).items() if stays}
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame([(r["doc_id"], r["text"]) for r in good if r["doc_id"] in kept], "doc_id long, text string")).collect()}
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for r in good:
        if r["doc_id"] not in kept:
            continue
        text, out, at = r["text"] or "", [], 0
        assert {("%s" % s.kind, s.start, s.end) for s in found[r["doc_id"]] if s.seed} == set(slow_exact(text))
        for start, end, kind in sorted((s.start, s.end, s.kind) for s in found[r["doc_id"]]):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        ids = np.array([*tokenizer.encode("".join([*out, text[at:]]), add_special_tokens=False).ids, 2], "<u4")
        want += [(r["doc_id"], s, len(part := ids[s:s + 4096]), zlib.crc32(part.tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    pieces = entry.queries()["pipeline"](spark, SF).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == sorted(want) and len(want) > 50
    places = defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 4096
    assert json.dumps(sorted(places)) == json.dumps(list(range(len(places))))
