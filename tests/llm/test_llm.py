"""Each operator against brute force or a round trip, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
import base64
import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from waymesh.llm import ann, bpe, chat, htmltext, linktrust, neardup, packing, pii, quality, warc, words

RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdefghijklmnop") for _ in range(RANDOM.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near_texts():
    base, rows = prose(120, 1).split(), []
    rows += [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, prose(20_000, 2)), (6, prose(20_000, 2).upper()), (7, prose(80, 3))]
    for i in range(30):  # copies of copies: neighbours are linked, far ones are not
        for at in RANDOM.sample(range(len(base)), 2):
            base[at] = f"new{i}"
        rows.append((100 + i, " ".join(base)))
    rows += [(200 + i, prose(60, 10 + i)) for i in range(20)] + [(300 + i, prose(70, 4)) for i in range(25)]
    return rows


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_equal_brute_force(docs):
    rows = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == brute_components(rows)
    kept = neardup.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}
    assert neardup.near_duplicates(docs(rows).limit(0)).count() == 0


def test_blocks_find_every_link():
    left, right = np.arange(9, dtype=np.uint64), np.arange(12, dtype=np.uint64)
    assert neardup.linked(left, right) and not neardup.linked(left[:8], right)
    assert neardup.least_matches(16) < neardup.least_matches(128) <= 80
    rng = np.random.default_rng(1)
    for _ in range(300):  # no pair at the limit is pruned
        a = rng.integers(0, 1 << 32, (1, 128), dtype=np.uint64)
        b = np.where(rng.random((1, 128)) < 0.75, a, a + 1)
        assert len(neardup.likely(a, b)) == 1


def test_word_hashes_over_blocks(monkeypatch):
    text = prose(500, 6) + " " + "x" * 3000 + " é ü\x0b" + prose(50, 7)
    whole = words.word_hashes(text.encode())
    monkeypatch.setattr(words, "BLOCK", 64)
    assert (words.word_hashes(text.encode()) == whole).all() and len(whole) == len(text.split())


def test_quality_measures_and_bounds(spark, docs):
    rows = [(0, None), (1, ""), (2, "a b c a b c"), (3, "# x\ny\n# x\n\n# x"), (4, prose(3000, 1)), (4, prose(60, 2))]
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(quality.measures(docs(rows)), labels).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert (by[2][0].n_words, by[2][0].word_chars, by[2][0].n_repeat_words, by[2][0].base_failed) == (6, 6, 6, True)
    assert (by[3][0].n_dup_lines, by[3][0].n_symbols) == (2, 3) and by[0][0].n_words == 0 and len(by[4]) == 2
    assert all(r.kept for r in by[4])
    assert quality.keep_good(docs(rows), labels).columns == docs(rows).columns and quality.keep_good(docs(rows), labels).count() == 2
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01, abs=1e-9)
    counts = np.zeros((len(quality.RULES), quality.GRID), np.int64)
    counts[:, 3] = 20_000
    assert all(c == 4 for c in quality.certified_cutoffs({"en": counts})["en"])
    assert all(c == quality.GRID for c in quality.certified_cutoffs({})["de"])


def luhn_number(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    return next("".join(map(str, digits)) + str(c) for c in range(10) if pii.luhn("".join(map(str, digits)) + str(c)))


def slow_exact(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) \
                    or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_exact_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "22", "255", "256", ".", "..", "@", "a", "b.c", "-", " ", "+", "(", ")", "+1 (555) 555-0100", luhn_number(rng), "x@y.z", "é"]) for _ in range(12))
        assert pii.exact(text) == slow_exact(text), text
    assert pii.exact("a" * 200_000 + "1" * 200_000) == []


def test_context_finds_unseen_identifiers(spark, docs):
    rng = random.Random(3)
    rows = [(i, f"{prose(30, i)} mail address: user{i}@host{i}.org {prose(10, i + 99)}") for i in range(30)]
    rows += [(100, f"{prose(12, 500)} mail address: someone(at)somewhere {prose(9, 501)}"), (101, f"{prose(9, 77)} 12:30 of 4.5.6 {prose(9, 78)}"), (102, None), (103, "")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs(rows)).collect()}
    text = dict(rows)
    assert [(s["kind"], s["seed"], text[100][s["start"]:s["end"]]) for s in got[100]] == [("email", False, "someone(at)somewhere")]
    assert got[101] == [] and got[102] == [] and got[103] == [] and all(len(got[i]) == 1 for i in range(30))
    clean = {r.doc_id: r.text for r in pii.redact(docs(rows)).collect()}
    assert clean[5].count("<EMAIL>") == 1 and "@" not in clean[5] and clean[102] is None and "<EMAIL>" in clean[100]
    assert pii.find_personal_data(docs(rows).limit(0)).count() == 0 and rng


def test_byte_bpe_equals_tiktoken(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, own = random.Random(4), bpe.Encoder(path, P.PATTERN)
    texts = ["".join(rng.choice("aeinorst  \n'sTé漢😀0.!<|") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["ab" * 20_000, " " * 5000]
    assert all(own.encode(t) == want.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode() for t in texts)
    rows = [(0, None), (1, ""), (2, texts[7]), (2, texts[7])]
    got = bpe.round_trip_digests(docs(rows), path, P.PATTERN).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got)[:2] == [(0, 0), (1, 0)] and len(got) == 4
    assert {r.decoded_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(texts[7].encode()).hexdigest()}
    assert {tuple(r.ids) for r in bpe.encode_column(docs(rows), path, P.PATTERN).collect()} == {(), tuple(want.encode_ordinary(texts[7]))}


def test_packing_holds_every_token_once(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = [(0, None), (1, ""), (2, prose(30_000, 1)), (3, "x\x1cy, İ, é.\n a.b ,.")] + [(10 + i, prose(40 + i % 7, i)) for i in range(200)] + [(999, prose(60, 0))] * 30
    packed = packing.pack_documents(docs(rows), path, with_ids=True)
    pieces, tokenizer = packed.collect(), Tokenizer.from_file(path)
    text = dict(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.length == len(p.ids) // 4
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert len(by_doc[999]) == 30
    for doc in set(text) - {999}:
        ids = b"".join(bytes(p.ids) for p in sorted(by_doc[doc], key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text[doc] or "", add_special_tokens=False).ids, 2]
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= total / 4096 * 1.02 + 2
    assert sorted(len(r.ids) // 4 for r in packing.sequences(packed).collect()) == sorted(sum(n for _, n in v) for v in by_sequence.values())
    assert packing.pack_documents(docs(rows).limit(0), path).count() == 0


def test_archives_round_trip(spark):
    pages = [(1, "http://a/ü b", "<p>é</p>"), (5, None, None), (7, "x", ""), (9, "y", "<p>é</p>"), (9, "y", "<p>é</p>"), (3, "z", "q" * 100_000)] + [(100 + i, "h", f"{i % 3}") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload_digest", F.lit(1))
    root = f"file://{warc.scratch(spark, 'w')}"
    manifest = warc.write_archives(df, root, shard_bytes=20_000, file_bytes=2000)
    got = warc.read_archives(manifest, root).collect()
    most = defaultdict(int)
    for i, _, h in pages:
        most[h or ""] = max(most[h or ""], i)
    want = sorted((i, len((h or "").encode()), "response" if most[h or ""] == i else "revisit", None if most[h or ""] == i else most[h or ""]) for i, _, h in pages)
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want or \
        sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all(bytes(r.payload).decode() == dict((i, h) for i, _, h in pages).get(r.page_id, "") or r.page_id in (5,) for r in got if r.payload)
    again = warc.write_archives(df.repartition(5), f"{root}-2", shard_bytes=20_000, file_bytes=2000)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect())) and manifest.count() > 2
    assert warc.archived(df.limit(0)).count() == 0


def test_neighbours_find_nine_in_ten(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1200, 16)) * rng.uniform(0.5, 3, (1200, 1))
    v[100:500] = v[100]  # one vector that a third of all rows share
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    hits = 0
    for q, found in got.items():
        score = v @ v[q]
        best = sorted((i for i in range(1200) if i != q), key=lambda i: (-round(score[i], 9), i))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(s == pytest.approx(score[i]) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(best))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_beside_very_long_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[1::200] *= 1e4
    v[2::200] *= 1e-200  # their squares are zero
    queries = np.arange(0, 1000, 20)
    index = ann.build_index(spark.createDataFrame([(x.tolist(), i) for i, x in enumerate(v)], "v array<double>, vec_id long"), 21)
    asked = spark.createDataFrame([(int(i), v[i].tolist()) for i in queries], "query_id long, v array<double>")
    got = defaultdict(set)
    for r in ann.search(asked, index).collect():
        got[r.query_id].add(r.vec_id)
    best = {q: set(sorted((i for i in range(1000) if i != q), key=lambda i: -(v[i] @ v[q]))[:20]) for q in queries}
    assert sum(len(got[q] & best[q]) for q in queries) >= 0.95 * 20 * len(queries)


def test_pruning_equals_plain_rule_at_every_scale():
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e-2, 1e-4):
        center = rng.normal(size=9)
        v = center / np.linalg.norm(center) + scale * rng.normal(size=(40, 9))
        v = v.astype(np.float32)
        exact, want = v.astype(np.float64), []
        alive = sorted(range(1, 40), key=lambda i: ((exact[i] - exact[0]) ** 2).sum())
        while alive and len(want) < ann.DEGREE:
            want.append(alive.pop(0))
            alive = [i for i in alive if ann.ALPHA**2 * ((exact[i] - exact[want[-1]]) ** 2).sum() > ((exact[i] - exact[0]) ** 2).sum()]
        got = ann.robust_prune(v, np.array([0]), np.arange(40)[None, :])[0]
        assert got[got >= 0].tolist() == want


def test_page_text(spark):
    article = "<article class='post-1'><header>top</header><h1>Title &amp; more</h1><p>First  <b>bold</b>\n line.<p>Second<br>line <script>var a='</p>'</script>here.<ul><li>a<li>b</ul></article>"
    page = (f"<html><head><title>t</title></head><body><nav>menu</nav><div class=\"cookie-notice\">agree</div><div class='wrap'><div id='sidebar'>side</div>{article}"
            "<section id=comments><article class='comment'>nice</article></section><form>mail <input></form></div><aside>more</aside><footer>&copy;</footer>")
    rows = [(1, "http://h.org/a", page), (2, "http://h.org/b", None), (3, None, ""), (4, "http://h.org/c", "plain <b>text"), (1, "http://h.org/a", page), (5, "u", "<" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in htmltext.extract(df, htmltext.host_paths(df)).collect()}
    assert got[1].text == "Title & more\nFirst bold line.\nSecond line here.\na\nb" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text) == ("", "", "plain text")
    assert htmltext.main_text(html.unescape("&lt;p&gt;x"), None) == "x"


def test_page_text_keeps_all_running_text(spark):
    lead, rest, other = prose(60, 11), prose(180, 12), prose(150, 13)
    links = "<div class='more'><a href='/x'>one</a> | <a href='/y'>two</a></div>"
    usual = f"<html><body><nav>menu</nav>{links}<div class='page'><div class='lead'><p>{lead}</p></div><div class='rest'><p>{rest}</p></div></div></body></html>"
    second = f"<html><body><div class='page'><p>{lead}</p></div><div class='story'><p>{other}</p><p><a href='/z'>{rest}</a> {lead}</p></div>{links}</body></html>"
    outside = f"<html><body><div class='intro'><p>{lead}</p></div><a name='top'><article><p>{rest}</p></article></body></html>"
    rows = [(i, f"http://h.org/{i}", usual) for i in range(5)] + [(5, "http://h.org/5", second), (6, "http://h.org/6", outside)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    winners = htmltext.host_paths(df)
    assert [r.path for r in winners.collect()] == ["/body/div.page"]
    got = {r.page_id: r.text for r in htmltext.extract(df, winners).collect()}
    assert all(got[i] == f"{lead}\n{rest}" for i in range(5))
    assert got[5] == f"{lead}\n{other}\n{rest} {lead}\none | two" and got[6] == f"{lead}\n{rest}"


def test_page_text_under_marked_wrappers():
    text, side = prose(80, 14), "<div class='sidebar'>side</div><div id='comments'><article class='comment'>nice</article></div>"
    for wrapper, inner in (("div id=page class='has-sidebar'", f"<article><p>{text}</p></article>"), ("article class='post no-comments'", f"<p>{text}</p>"),
                           ("article class='post category-legal tag-social'", f"<p>{text}</p>"), ("div class='page-with-sidebar'", f"<p>{text}</p>"),
                           ("div class='social'", f"<article><p>{text}</p></article>"), ("div id='related'", f"<main><p>{text}</p></main>"),
                           ("div class='legal'", f"<p>{text}</p>"), ("article class='sponsored'", f"<div class='widget'><p>{text}</p></div>")):
        page = f"<html><body>{side}<{wrapper}>{inner}</{wrapper.split()[0]}><div class='widget-tag-cloud'>tags</div></body></html>"
        assert htmltext.main_text(page, htmltext.best_path(page)[0]) == text, wrapper
    page = f"<html><body><div class='header'><h1>Title</h1>by me</div><div class='text'><p>{text}</p></div>{side}</body></html>"
    assert htmltext.main_text(page, None) == f"Title\nby me\n{text}"
    page = f"<html><body><div class='ad'>{text}</div><article><p>short</p></article></body></html>"
    assert htmltext.main_text(page, None) == "short"
    assert htmltext.main_text(f"<body><p>{text} <span class='share'>to <b>all</b></span>end</p>", None) == f"{text} end"
    assert htmltext.main_text(f"<body><span class='notice'>{text}</span><p>end</p>", None) == f"{text}\nend"


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|a<\\\\|<", "", None, "x<", "|<|<|"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, None, "a"), (2, 0, None, "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(chat.text_parts(df)).collect()}
    assert chat.read_back(out[1].formatted) == [(r, t or "") for _, _, r, t in rows[:6]] and out[2].n_turns == 2
    spans = [chat.unescape(out[1].formatted[s.start:s.end]) for s in out[1].loss_spans]
    assert spans == [t or "" for t in hard[1::2]]
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see <|x|>", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", None)])],
                                  f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    made = chat.format_conversations(parts).collect()[0]
    assert [(a.type, a.ref, a.tokens, made.formatted[a.start:a.start + len(a.type) + 4]) for a in made.attachments] == [
        ("image", "a.png", 512, "<|image|>"), ("audio", "b.wav", 75, "<|audio|>"), ("document", "c.pdf", 512, "<|document|>")]
    assert made.expanded_tokens == 1099 and chat.format_conversations(parts.limit(0)).count() == 0


def test_urls(spark):
    def links(*hosts):
        return "".join(f'<a class=x href="http://{h}/">l</a>' for h in hosts)

    rows = [(1, "http://A.org/x", links("good.net")), (2, "http://b.example.org/es/1", ""), (3, "http://b.example.org/en/12?q", ""), (4, "http://c.com/fr/", ""), (5, "http://bad.com/de/", ""),
            (6, "nothing", None), (7, None, None), (8, "http://org", ""), (9, "http://farm.net/p#f", links("bad.com", "bad.com")), (10, "http://good.net?x", ""), (11, "http://x.io/://y", ""),
            (12, "http://forg/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linktrust.judge_urls(df).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3][1:] == ("/en/12", "example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("org", "", None, "allow") and got[9] == ("farm.net", "/p", None, "block") and got[10] == ("good.net", "", None, "allow")
    assert got[11][:2] == ("x.io", "/://y") and got[12][2] is None
    assert linktrust.judge_urls(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    final = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in final.select("doc_id").distinct().collect()}
    assert ids <= {r.doc_id for r in good.select("doc_id").collect()} and len(ids) > 50
