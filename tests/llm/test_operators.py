import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from infocausal.llm import (
    op1_icws_neardup as op1,
    op2_redirects as op2,
    op3_pair_index_bpe as op3,
    op4_token_files as op4,
    op5_jump_shards as op5,
    op6_ecoc_langid as op6,
    op7_spaced_seeds as op7,
    op8_bwt_dedup as op8,
    op9_host_rules as op9,
    op10_chat_format as op10,
    units,
)
from infocausal.llm.common import scratch_dir
from infocausal.llm.units import Plan, deal, documents_with, each_unit, key_pairs
from tests.llm.fixtures import empty, messy, words


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


# ------------------------------------------------------------------ 1


def brute_weights(docs, p=op1.NearDup()):
    """id -> {shingle: tf * idf} by plain counting; docs: (id, text), an id once."""
    cut = {d: [tuple(w[i : i + p.words]) for i in range(max(len(w) - p.words + 1, min(len(w), 1)))] for d, t in docs for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]}
    df = Counter(s for d in cut for s in set(cut[d]))
    n = len(docs)
    return {d: {s: c * (1 + math.log(n / df[s]) / math.log(max(n, 2))) for s, c in Counter(x).items()} for d, x in cut.items()}


def brute_similarity(a, b):
    least = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least) if least else 0.0


def brute_classes(docs, p=op1.NearDup(), weights=None):
    """id -> smallest id, by comparing all pairs; docs: (id, text) with an id once."""
    docs = [(d, t) for d, t in docs if d is not None]
    ids, text = sorted(d for d, _ in docs), {d: t or "" for d, t in docs}
    weight = weights or brute_weights(docs, p)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if text[a] == text[b] or brute_similarity(weight[a], weight[b]) >= p.similarity - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_neardup_equals_all_pairs(spark):
    docs = messy(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    once = list({r: None for r in rows})
    want = brute_classes(once)
    single = spark.createDataFrame(once, "doc_id long, text string")
    assert {r.id: r.class_id for r in op1.near_classes(single).collect() if r.id is not None} == want
    assert len(set(want.values())) < len(want) - 8
    got = op1.near_classes(docs).collect()
    assert Counter(r.id for r in got) == Counter(d for d, _ in rows) and {r.class_id for r in got if r.id is None} == {None}
    kept = op1.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({r.class_id for r in got}) and ids.count(None) == 1
    assert op1.near_classes(empty(spark)).count() == 0


def test_recall_at_sf001(spark):
    """All pairs that share a shingle, by brute force over the whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weight = brute_weights(rows)
    holds, links, first = {}, set(), {}
    for d, t in rows:
        if t in first:
            links.add((first[t], d))
        first.setdefault(t, d)
    for d in first.values():
        for s in weight[d]:
            holds.setdefault(s, []).append(d)
    common = Counter((a, b) for v in holds.values() for i, b in enumerate(v) for a in v[:i])
    near = {x for x, c in common.items() if 2 * c >= 0.6 * min(len(weight[x[0]]), len(weight[x[1]])) and brute_similarity(weight[x[0]], weight[x[1]]) >= 0.8}
    got = {r.id: r.class_id for r in op1.near_classes(docs).collect()}
    found = sum(got[a] == got[b] for a, b in near | links)
    print(f"recall {found}/{len(near | links)}, near {len(near)}")
    assert near and found >= 0.9 * len(near | links) and all(got[a] == got[b] for a, b in links)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near | links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(find(got[d]) == find(d) for d in root)


def test_large_mixed_bucket_finds_every_pair(spark):
    rng = random.Random(11)
    template = words(rng, 60)
    p = op1.NearDup(bands=1, rows=1, piece=100)
    docs = []
    for i in range(300):
        own = words(rng, 60).split()
        docs += [(2 * i, template + " " + " ".join(own)), (2 * i + 1, template + " " + " ".join(own[:57]) + " " + words(rng, rng.randrange(3, 6)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = frame.select(F.col("doc_id").alias("id"), "text")
    signed = {r.id: r for r in op1.signed_texts(rows, op1.Plan.of(len(docs), sum(len(t) for _, t in docs)), p).collect()}
    weight = brute_weights(docs)
    for i, r in list(signed.items())[:20]:
        assert r.weight == pytest.approx(sum(weight[i].values()))
    # What is left out can have no partner.
    planted = [(i - 1, i) for i in range(1, 600, 2) if brute_similarity(weight[i - 1], weight[i]) >= p.similarity]
    assert planted and all(i in signed for x in planted for i in x)
    size = Counter(r["keys"][0] for r in signed.values())
    planted = [x for x in planted if signed[x[0]]["keys"] == signed[x[1]]["keys"]]
    assert sum(size[signed[a]["keys"][0]] > 100 for a, _ in planted) > 20
    got = {r.id: r.class_id for r in op1.near_classes(frame, p=p).collect()}
    assert [(a, b) for a, b in planted if got[b] != got[a]] == []


def test_block_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    for turn in range(30):
        n = int(rng.integers(1, 40))
        lists = [(x := np.sort(rng.choice(30, int(rng.integers(0, 12)), replace=False).astype(np.uint64)), rng.integers(1, 3, len(x)).astype(float)) for _ in range(n)]
        total = np.array([w.sum() for _, w in lists]) + rng.integers(0, 2, n)
        part, side = rng.integers(0, 12, n), rng.random(n) < 0.4 if turn % 2 else np.zeros(n, bool)
        x, y = op1.block_links(part, side, total, lists, 0.5)
        want = {(i, j) for i in range(n) for j in range(n) if (side[j] and not side[i] if side.any() else i < j) and part[i] != part[j] and op1.similarity((*lists[i], total[i]), (*lists[j], total[j])) >= 0.5}

        def closed(links, part=part):
            root = {}

            def find(v):
                while root.get(v, v) != v:
                    v = root[v]
                return v

            for i, j in links:
                a, b = sorted((find(part[i]), find(part[j])))
                root[b] = a
            return [find(v) for v in part]

        assert closed(zip(x.tolist(), y.tolist(), strict=True)) == closed(want) and len(x) <= n


def test_documents_with_a_key(spark):
    """Counts over many small units, with more texts than spare bits, against plain counting."""
    texts = [f"{i % 7} {i % 11} {i % 13} same" for i in range(400)]
    docs = [(i, texts[i]) for i in range(400)] + [(1000 + i, texts[i]) for i in range(50)]
    rows = spark.createDataFrame(docs, "id long, text string").repartition(5)

    def keys(found):
        part = [x.split() for x in found]
        return np.array([int.from_bytes(hashlib.sha256(w).digest()[:8], "little") for x in part for w in x], np.uint64), np.repeat(np.arange(len(part)), [len(x) for x in part])

    df = Counter(w for _, t in docs for w in set(t.split()))
    distinct = Counter(w for t in set(texts) for w in set(t.split()))
    for plan in (Plan(450, 1, 9, 4, 48), Plan(450, 1, 2, 3, 60)):
        dealt = deal(rows, plan)
        seen = {}

        def run(unit, first, copies, found, counts, plan=plan):
            k, owner, _ = key_pairs(*keys(found), len(found), plan.bits)
            assert sum(copies) >= len(found)
            word = {int(h) >> (64 - plan.bits): w.decode() for x in found for w, h in zip(x.split(), keys([x])[0], strict=True)}
            u = np.unique(k)
            yield pa.RecordBatch.from_arrays([pa.array([word[int(x)] for x in u]), pa.array(counts)], ["word", "n"])

        for r in each_unit(dealt, documents_with(dealt, plan, keys), run, "word string, n long").collect():
            assert r.n == (df[r.word] if distinct[r.word] > 1 else 0), r
            seen[r.word] = r.n
        assert set(seen) == set(df)


def test_sample_collisions_follow_weighted_jaccard():
    rng = np.random.default_rng(1)
    p = op1.NearDup(samples=512)
    for common in (100, 200, 250):
        s = np.sort(rng.integers(0, 1 << 48, 560 - common, np.uint64))
        w = rng.uniform(1, 4, len(s))
        a, b = np.arange(280), np.arange(280 - common, 560 - common)
        v = w.copy()
        v[b[: common // 2]] *= 1.5
        sig = op1.signatures(np.concatenate([s[a], s[b]]), np.concatenate([w[a], v[b]]), np.array([0, 280, 560]), p)
        true = op1.similarity((s[a], w[a], w[a].sum()), (s[b], v[b], v[b].sum()))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.07


# ------------------------------------------------------------------ 2


def test_redirects(spark):
    page = lambda i, url, html=None: (i, url, html, "h", "p", "k")
    rows = [
        page(1, "https://A.example.com/en/8?x#y"), page(2, "http://example.com/en/70"), page(3, "http://x.net/de/1"), page(4, "http://w.example.net/de/81"),
        page(5, "ftp://plain"), page(6, None), page(7, "no scheme"), page(8, "http://ok.org/a", '<link rel="canonical" href="/b">'),
        page(9, "http://ok.org/b", "<meta http-equiv='refresh' content='0; url=http://other.com/en/1'>"), page(10, "http://ok.org/b"),
        page(11, "http://example.com/en/71", '<LINK href=http://other.com/en/1 rel=canonical>'), page(12, "http://notexample.com/de/"), page(13, "http://alone.org/x", ""), page(13, "http://alone.org/x", ""),
    ]
    schema = "page_id long, url string, html string, host string, path string, key string"
    got = {r.page_id: r for r in op2.judge(spark.createDataFrame(rows, schema)).collect()}
    verdicts = {i: (r.rule, r.verdict, r.decided_by) for i, r in got.items()}
    assert verdicts[1] == ("com/en/", "block", "rule") and verdicts[2] == ("example.com/en/7", "allow", "rule")
    assert verdicts[3] == ("net/de/", "allow", "rule") and verdicts[4] == ("example.net/de/8", "block", "rule")
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/8") and (got[5].host, got[5].path) == ("plain", "") and (got[6].host, got[7].path) == ("", "")
    assert all(verdicts[i] == (None, "block", "alias") for i in (8, 9, 10))
    assert verdicts[11] == ("example.com/en/7", "allow", "rule")
    assert all(verdicts[i] == (None, "allow", "none") for i in (5, 6, 7, 12, 13))
    assert op2.judge(spark.createDataFrame(rows, schema)).count() == len(rows)
    assert op2.judge(spark.createDataFrame([], schema)).count() == 0
    urls = spark.createDataFrame([(r[0], *[x or "" for x in (got[r[0]].host, got[r[0]].path)]) for r in rows], "id long, host string, path string")
    rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in op2.RULES], "host string, path string, verdict string")
    assert {r.id: r.rule for r in op2.rules_by_join(urls, rules).collect()} == {i: v[0] for i, v in verdicts.items() if v[0]}


def test_redirects_equal_union_find(spark):
    rng = random.Random(31)
    url = lambda i: f"http://{('a', 'b', 'ok', 'www.c', 'm.c')[i % 5]}.{('com', 'org', 'net', 'info')[i % 4]}/{('en', 'de', 'x', 'es')[i % 4 if i % 3 else 2]}/{i}"
    edges = [(i, i + 1) for i in range(0, 60, 1) if i % 10] + [(70, 71), (71, 72), (72, 70)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(60)]
    to = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    rows, links = [], []
    for i in range(200):
        html = None
        if i in to:
            html = f'<link data-href="http://bad.com/en/1" rel="canonical" href="{url(to[i][0])}">'
            links += [(url(i), url(x)) for x in to[i][1:]]
        rows.append((i, url(i), html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict, r.decided_by) for r in op2.judge(pages, spark.createDataFrame(links, "src string, dst string")).collect()}

    def plain_rule(i):
        host, path = re.match(r"http://([^/]*)(.*)", url(i)).groups()
        fits = [r for r in op2.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    bad = {find(i) for i in range(200) if (r := plain_rule(i)) and r.verdict == "block"}
    for i in range(200):
        r = plain_rule(i)
        want = (r.text, r.verdict, "rule") if r else (None, "block", "alias") if find(i) in bad else (None, "allow", "none")
        assert got[i] == want, (i, url(i))
    assert {v[2] for v in got.values()} == {"rule", "alias", "none"}


def test_common_redirects_and_targets(spark):
    urls = ["http://www.a.com/x?utm_source=n&id=3&ref=q#f", "https://m.b.org/", "http://c.net/y?ref=1", "http://www.com/z", "http://d.com/w?a=1", None, "plain"]
    got = [r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select(op2.plain_url(F.col("u")).alias("p")).collect()]
    assert got == ["https://a.com/x?id=3", "https://b.org/", "https://c.net/y", "https://www.com/z", "https://d.com/w?a=1", None, None]
    page = [(1, "http://h.org/a/b?q", '<meta http-equiv="refresh" content="0; url=/go?to=http://x.com/en/1">')]
    edges = op2.link_edges(spark.createDataFrame(page, "page_id long, url string, html string")).collect()
    assert [(r.src, r.dst) for r in edges] == [("http://h.org/a/b?q", "http://h.org/go?to=http://x.com/en/1")]


# ------------------------------------------------------------------ 3 and 4

ALPHABET = "aabcdeeé ΣσςİIß'st'll\n\t\x0b\x1c\x85\xa0 ​0129½٣<|endoftext|>ǅﬁ́Å中文😀᠎﻿\0.,!?-_  "
BITS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "  ", "'S", "'re", "ΑΣ", " \n", "the", "of,"]


def strange(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) if rng.random() < 0.75 else rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_library():
    lib = tokenizer("word_bpe_49k.json")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = op3.PairIndexBPE(f.read())
    own.pieces.most = own.known.most = 500
    for t in strange(2000, 1):
        ids = lib.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode([t])[0], "<i4").tolist()
        assert got == ids, repr(t)
        assert own.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_frames(spark):
    docs, lib = messy(spark), tokenizer("word_bpe_49k.json")
    got = op3.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("id",)).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), str(ids), lib.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), str(r.ids), r.decoded) for r in got) == sorted(want)
    assert op3.encode_decode(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_cached_tokenizer_equals_library():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = op4.CachedTokenizer(f.read())
    own.table.most = 500
    lib = tokenizer("byte_bpe_50k.json")
    for t in strange(3000, 2):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK_BYTES", 3000)
    docs, lib = messy(spark), tokenizer("byte_bpe_50k.json")
    folder = f"{scratch_dir(spark)}/tokens-test-{random.random()}"
    op4.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at, want = 0, []
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, ids))
        at += len(ids)
    got = sorted(op4.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got] == want
    few = {r.doc_id: bytes(r.ids) for r in op4.read_documents(spark, folder, [3, 9]).collect()}
    assert set(few) == {3, 9} and np.frombuffer(few[3], "<u4").tolist() == next(w[2] for w in want if w[0] == 3)
    head = spark.read.parquet(f"{folder}/dictionary").first()
    assert hashlib.sha256(bytes(head.dictionary)).hexdigest() == head.dict_hash
    none = f"{folder}-none"
    op4.write_tokens(empty(spark), none, public_tokenizers.path("byte_bpe_50k.json"))
    assert op4.read_tokens(spark, none).count() == 0


# ------------------------------------------------------------------ 5


def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_law():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    for n in (1, 2, 24, 1000):
        assert op5.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    before, after = op5.jump(keys, 24), op5.jump(keys, 25)
    assert set(after[before != after]) == {24} and 0.02 < (before != after).mean() < 0.06


def test_shards(spark):
    docs = messy(spark)
    got = op5.assign(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in got)
    hashed = {r.doc_id: r.h % 2**64 for r in docs.select("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(0))).alias("h")).collect()}
    assert all((r.law, r.shard, r.grown_shard) == ("key", plain_jump(hashed[r.doc_id], 24), plain_jump(hashed[r.doc_id], 25)) for r in got)
    assert op5.assign(empty(spark)).count() == 0


# ------------------------------------------------------------------ 6


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = op6.learn(docs.filter(~held))
    test = docs.filter(held & (F.length("text") > 40))
    got = op6.predict(test, model, keep=(F.col("doc_id"), F.col("lang"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: (r.text, r.lang_pred, r.score) for r in op6.predict(messy(spark), model, keep=(F.col("doc_id"), F.col("text"))).collect()}
    for text, lang, score in odd.values():
        has = text is not None and any(c.isalpha() for c in text)
        assert (lang != "und") == has and (has or score == 0)
    assert op6.learn(empty(spark)) is None
    assert {r.lang_pred for r in op6.predict(messy(spark), None).collect()} == {"und"}
    assert op6.predict(empty(spark), model).count() == 0
    one = op6.fit(["aaa bbb"], ["xx"])
    assert one.decode(np.stack([one.margin(op6.slots("zzz"))]))[0] == ["xx"]


def test_decoding_by_hand():
    """Margins, losses, winner, score and flag of single texts by plain loops."""
    rng = random.Random(17)
    texts, labels = [words(rng, 12) + x * 6 for x in (" der und", " les et", " los y") for _ in range(30)], [x for x in ("de", "fr", "es") for _ in range(30)]
    model = op6.fit(texts, labels)
    for text in [*texts[::13], "der", "y los les", words(rng, 3)]:
        raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
        raw = [b for i, b in enumerate(raw) if i == 0 or b != 32 or raw[i - 1] != 32]
        grams = []
        for order in op6.ORDERS:
            for i in range(len(raw) - order + 1):
                h = 0
                for b in raw[i : i + order]:
                    h = (h * 257 + b) % 2**32
                grams.append(((h + order * 7919) * 2654435761) % 2**32 >> (32 - op6.BITS_OF_HASH))
        margin = [sum(float(model.weights[g, b]) for g in grams) / len(grams) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-m * int(c))) for w, m, c in zip(model.bit_weight, margin, row, strict=True)) / sum(model.bit_weight) for row in model.code]
        best, second = sorted(range(3), key=lambda k: (loss[k], k))[:2]
        lang, score, doubt = model.decode(np.stack([model.margin(op6.slots(text))]))
        assert lang[0] == model.languages[best] and bool(doubt[0]) == (loss[second] - loss[best] < op6.AMBIGUOUS)
        assert score[0] == pytest.approx(1 / sum(math.exp(-4 * (x - loss[best])) for x in loss), rel=1e-3)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        c = op6.codewords(n).astype(int)
        apart = (c[:, None] != c[None]).sum(2)
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)
    assert (op6.codewords(4)[:, None] != op6.codewords(4)[None]).sum(2)[0, 1] == 4


# ------------------------------------------------------------------ 7


def test_masks_catch_every_window():
    from itertools import combinations

    for w in range(5, op7.WINDOW + 1):
        for k in range(w - op7.needed(w) + 1):
            for wrong in combinations(range(w), k):
                assert any(all(o + x not in wrong for x in m) for m in op7.MASKS for o in range(w - m[-1])), (w, wrong)


def test_items_without_an_id_are_found(spark):
    rng = random.Random(12)
    a, b = words(rng, 20), words(rng, 20)
    bench = spark.createDataFrame([(None, a), (5, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(rng, 30) + " " + a), (2, words(rng, 30) + " " + b), (3, words(rng, 60))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op7.overlaps(docs, bench).collect()} == {(1, None), (2, 5)}
    assert [r.doc_id for r in op7.drop_contaminated(docs, bench).collect()] == [3]


def brute_overlaps(docs, items):
    cut = lambda t: [x for x in re.split(r"[\x09-\x0d\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", (t or "").lower()) if x]
    out = set()
    for d, t in docs:
        a = cut(t)
        for i, x in items:
            b = cut(x)
            w = min(op7.WINDOW, len(b))
            if 0 < w < 5 and a == b:
                out.add((d, i))
            elif w >= 5 and any(sum(a[p + k] == b[q + k] for k in range(w)) >= op7.needed(w) for p in range(len(a) - w + 1) for q in range(len(b) - w + 1)):
                out.add((d, i))
    return out


def test_decontamination_equals_all_pairs(spark):
    rng = random.Random(8)
    items = [(i, words(rng, n)) for i, n in enumerate((4, 5, 8, 12, 13, 20, 40))] + [(7, None), (8, ""), (9, "same as ever " * 5)]
    items.append((10, items[6][1]))
    docs = [(i, words(rng, 60)) for i in range(6)]

    def planted(t, wrong):
        w = t.split()
        for k in wrong:
            w[k] = "zzz"
        return words(rng, 30) + " " + ", ".join(w).upper() + ". " + words(rng, 30)

    for n, (i, t) in enumerate(items[:7]):
        docs += [(100 + n, planted(t, [])), (200 + n, planted(t, [len(t.split()) // 2])), (300 + n, planted(t, range(0, len(t.split()), 7))), (400 + n, planted(t, range(0, len(t.split()), 3)))]
    docs += [(500, None), (501, ""), (502, "same as ever " * 200), (100, docs[6][1]), (503, items[0][1].upper() + "."), (504, "x"), (505, items[0][1] + " more")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame([(*r, "x") for r in [*items, items[5]]], "item_id long, text string, seed string")
    got = op7.overlaps(d, b).collect()
    want = brute_overlaps(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(106, 6), (206, 6), (306, 6), (503, 0)} <= want and (406, 6) not in want
    left = op7.drop_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert op7.overlaps(empty(spark), b).count() == 0 and op7.overlaps(d, b.limit(0)).count() == 0
    assert op7.drop_contaminated(messy(spark), b).count() == messy(spark).count()


# ------------------------------------------------------------------ 8


def brute_repeats(docs, n=op8.LENGTH):
    """doc_id -> (bytes, removed runs, kept) by a table of all strings."""
    first, raw = {}, {d: (t or "").encode() for d, t in docs}
    for d, x in raw.items():
        for i in range(len(x) - n + 1):
            w = x[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, x in raw.items():
        on = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if first[x[i : i + n]] < d:
                on[i : i + n] = b"\1" * n
        runs = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(on))]
        out[d] = (len(x), runs, bytes(b for b, c in zip(x, on, strict=True) if not c))
    return out


@pytest.mark.parametrize(("split", "merge_bytes"), [(op8.SPLIT, op8.MERGE_BYTES), (0, op8.MERGE_BYTES), (op8.SPLIT, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, split, merge_bytes):
    monkeypatch.setattr(op8, "SPLIT", split)
    monkeypatch.setattr(op8, "MERGE_BYTES", merge_bytes)
    monkeypatch.setattr(units, "UNIT_BYTES", 6000)
    monkeypatch.setattr(op8, "BIN_BYTES", 9000)
    docs = messy(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_repeats([r for r in dict(rows).items() if r[0] is not None])
    got = op8.remove_repeats(docs, carry=(F.col("doc_id"), F.col("text"))).select("row.*", "n_bytes", "spans", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        n, found, kept = want[r.doc_id] if r.doc_id is not None else (len(r.text), [], r.text.encode())
        assert (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == (n, found, kept), r.doc_id
    assert sum(len(x[1]) for x in want.values()) > 10
    clean = op8.drop_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for r in clean.collect():
        if r.doc_id is not None and r.text is not None:
            assert r.text == want[r.doc_id][2].decode(errors="ignore") and r.n_chars == len(r.text)
    assert op8.remove_repeats(empty(spark)).count() == 0 and op8.drop_repeats(empty(spark)).count() == 0


def test_the_merge_finds_what_goes(spark, monkeypatch):
    """Without the merged transforms only segments that are equal as a whole are left to be found."""
    rng = random.Random(21)
    base = words(rng, 40)
    rows = [(i, words(rng, 20) + base[i : i + 51] + words(rng, 20)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: {r.row.doc_id: bytes(r.kept) for r in op8.remove_repeats(docs).collect()}
    assert run() == {i: x[2] for i, x in brute_repeats(rows).items()}
    assert sum(len(x) < len(rows[i][1]) for i, x in run().items()) >= 25
    plan = Plan.of(len(rows), sum(len(t) for _, t in rows))
    dealt = deal(docs.withColumnRenamed("doc_id", "id"), plan)
    found = [r.asDict() for r in op8._segments(dealt, documents_with(dealt, plan, op8.minimizer_keys), plan, 1).collect()]
    assert len(set(op8.bin_spans(found)[0].tolist())) >= 25
    monkeypatch.setattr(op8, "covered_windows", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(set(op8.bin_spans(found)[0].tolist())) <= 5


def test_repeats_of_one_byte(spark):
    docs = [(1, "a" * 300_000), (2, "b" + "a" * 200_000 + "c"), (3, "ab" * 50_000), (4, "b" * 49 + "a" * 49), (5, "xab" + "ab" * 40)]
    want = {1: (0, 0), 2: (200_000, 1), 3: (0, 0), 4: (50, 1), 5: (82, 1)}
    got = {r.row.doc_id: (sum(s.end - s.start for s in r.spans), len(r.spans)) for r in op8.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_merged_transforms_find_all_repeats():
    rng = random.Random(4)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 70))).encode() for _ in range(60)]
    shared = "".join(rng.choice("abc") for _ in range(60)).encode()
    segments += [b"q" * k + shared[k : k + 52] + b"w" * 3 for k in range(6)] + [b"z" * 80, b"z" * 51, b"\x00" * 55, b"\xff" * 50]
    ids = [rng.randint(0, 40) for _ in segments]
    for shards in (1, 4):
        string, offset = op8.covered_windows(
            np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments]), np.zeros(len(segments)), np.array(ids), np.arange(len(segments)) % shards
        )
        want = [(k, p) for k, (s, i) in enumerate(zip(segments, ids, strict=True)) for p in range(len(s) - 49) if any(j < i and s[p : p + 50] in x for x, j in zip(segments, ids, strict=True))]
        assert list(zip(string.tolist(), offset.tolist(), strict=True)) == want


# ------------------------------------------------------------------ 9


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    on = {i + k for i, x in enumerate(tri) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(on)


def test_host_rules(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 60), None, "good") for i in range(20)] + [(100 + i, "too short # " * 3, None, "bad") for i in range(20)]
    rows += [(200, words(rng, 60), None, "bad"), (201, "a b c\n\na b c\nx", None, None), (202, ("a b c d " * 30), None, "good"), (203, None, None, "rare")]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_words long, n long, _q string, host_rate string")
    got = {r["_row"].doc_id: r for r in op9.host_rules(docs).collect()}
    for i, t, _, _ in rows:
        q = got[i]["_q"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_counts(t)
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
    hosts = {}
    for i, _, _, h in rows:
        hosts.setdefault(h, []).append(got[i]["_q"].base_failed)
    rates = [np.mean(v) for v in hosts.values()]
    m = np.mean(rates)
    v = np.var(rates) - m * (1 - m) * np.mean([1 / len(x) for x in hosts.values()])
    strength = max(m * (1 - m) / v - 1, 0) if v > 0 else 1000
    for i, _, _, h in rows:
        rate = (sum(hosts[h]) + m * strength) / (len(hosts[h]) + strength)
        assert got[i]["kept"] == (not got[i]["_q"].base_failed and rate <= 0.5) and got[i]["host_rate"] == pytest.approx(rate)
    assert got[0]["kept"] and not got[200]["kept"]
    assert op9.keep_good(docs).columns == docs.columns
    assert sorted(r.doc_id for r in op9.keep_good(docs).collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert op9.host_rules(messy(spark)).count() == messy(spark).count() and op9.keep_good(empty(spark)).count() == 0


# ------------------------------------------------------------------ 10


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<!|x", "<!!|", "a<", "<|", "", None, "é\n<|nl|>", "x" * 20000, "plain", "$1 \\ {}"]
    roles = ["user", "assistant", "sys\ntem", "", None, "assistant"]
    rows = [(c, t, roles[(c + t) % 6], texts[(3 * c + t) % 11], "x", "y") for c in range(11) for t in range(c + 1)] + [(None, 0, "user", "n", "x", "y"), (3, 1, "assistant", "again", "x", "y"), (3, 1, "assistant", "again", "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, formatted string")
    formatted = op10.format_turns(op10.canonical(df))
    back = {r.conv_id: r for r in op10.read_back(formatted).collect()}
    digests = {r.conv_id: r for r in op10.digests(op10.read_back(formatted)).collect()}
    by = {}
    for c, t, role, text, _, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(back) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in back[c].turns] == [x[1:] for x in turns]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        d = digests[c]
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert op10.format_turns(op10.canonical(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    frames = [
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, instruction string, output string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>"),
    ]
    for f in frames:
        assert [tuple(t) for t in op10.canonical(f).first().turns] == want
    extra = "conv_id long, turn long, role string, text string, prompt string, input string, messages array<struct<role:string,content:string>>, response string"
    rows = spark.createDataFrame([(1, 0, "user", "q", "x", "y", None, "z"), (1, 1, "assistant", "a", "x", "y", [], "z")], extra)
    assert [tuple(t) for t in op10.canonical(rows).first().turns] == want
    with pytest.raises(ValueError):
        op10.canonical(spark.createDataFrame([(1, "x")], "conv_id long, strange string"))
    bodies = ['{"prompt": "q", "response": "a"}', '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"instruction": "q", "input": "", "output": "a"}', "broken", None]
    got = op10.canonical_json(spark.createDataFrame(list(enumerate(bodies)), "conv_id long, body string"), "conv_id", "body").collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == {0: want, 1: want, 2: want, 3: [], 4: []}
    bodies = ['{"id": 7, "prompt": "q", "response": "a"}', '{"instruction": "q", "input": null, "output": "a", "score": [1, 2]}', '{"messages": [], "id": "x"}',
              '{"messages": [{"role": "user", "content": "q", "time": 3}, {"role": "assistant", "content": "a"}], "prompt": "p"}', '{"instruction": "q", "output": "a"}', '{"prompt": null, "completion": "a"}', "[]", '{"messages": "none"}', "{}"]
    got = op10.canonical_json(spark.createDataFrame(list(enumerate(bodies)), "conv_id long, body string"), "conv_id", "body").collect()
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in sorted(got)] == [
        ("prompt_response", want), ("instruction", want), ("messages", []), ("messages", want), ("instruction_only", want),
        ("prompt_completion", [("user", ""), ("assistant", "a")]), (None, []), (None, []), (None, []),
    ]


def test_long_conversation(spark):
    n = 4000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|t"), F.col("id")).alias("text"))
    r = op10.digests(op10.read_back(op10.format_turns(op10.canonical(rows)))).first()
    loss = "".join(f"<|t{i}" for i in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
