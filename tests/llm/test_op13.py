"""Packing against the tokenizers library, exact counts and best fit."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from infocausal.llm import op13_config_packing as op13
from infocausal.llm.queries import QUERIES
from tests.llm.fixtures import empty, messy, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "İ, a", "a!, b. c", "x́, ý. z", "don't, we'll. they're", "Σας, ΣΑΣ. σ", "3.14, 15. 9", "a ,b , c", "  two  spaces ", "\ttab\r\n, .", "<|endoftext|>, x<|startoftext|>. ",
    "ﬁ, ﬂ. ß", "日本, 語. カ", "éé", "...., ,,,. ", "a , b . c", "가, 각", "w. " * 500,
]


def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def best_fit(demand):
    """Sequences that longest-first best fit needs."""
    size, spaces = len(demand) - 1, []
    for x in range(size, 0, -1):
        for _ in range(int(demand[x])):
            fit = [s for s in spaces if s >= x]
            if fit:
                spaces.remove(min(fit))
                spaces.append(min(fit) - x)
            else:
                spaces.append(size - x)
    return len(spaces)


def test_ids_equal_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aB é,. \n!1Σİ́") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [words(rng, 50), ""]
    with open(VOCABULARY, encoding="utf-8") as f:
        model = op13.WordIds(f.read())
    own, bounds = model.encode(pa.array(texts, pa.string()))
    for t, i, j in zip(texts, bounds, bounds[1:], strict=False):
        assert own[i:j].tolist() == library().encode(t, add_special_tokens=False).ids if t in ODD else True, t
    got = [own[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)]
    assert got == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def whole(rows, docs, size):
    """The pieces are the documents', and each sequence is full from 0 on without gaps."""
    ids = {}
    for d, e in zip(docs, library().encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        x = np.array([*e.ids, 0], "<u4")
        for k in range(0, len(x), size):
            ids.setdefault((d[0], k // size, k, len(x[k : k + size]), zlib.crc32(x[k : k + size].tobytes())), []).append(1)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter({k: len(v) for k, v in ids.items()})
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= size
    return len(held)


@pytest.mark.parametrize("size", [64, 2048])
def test_messy_documents(spark, size):
    docs = messy(spark)
    rows = op13.pack_documents(docs, VOCABULARY, size=size).collect()
    n = whole(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], size)
    demand = np.zeros(size + 1, np.int64)
    for r in rows:
        demand[r["length"]] += 1
    assert n <= best_fit(demand)


def test_no_documents(spark):
    assert op13.pack_documents(empty(spark), VOCABULARY).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_demand(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(20, 200))
    demand = np.zeros(size + 1, np.int64)
    for x in rng.integers(1, size + 1, 30):
        demand[x] += int(rng.integers(1, 200))
    plan, lower = op13.plan_packing(demand)
    held = np.zeros(size + 1, np.int64)
    for made, n in plan:
        assert n > 0 and sum(x * k for x, k in made) <= size
        for x, k in made:
            held[x] += k * n
    assert (held == demand).all()
    used = sum(n for _, n in plan)
    assert lower <= used <= best_fit(demand) + 1


def test_beats_best_fit_where_it_errs():
    demand = np.zeros(2049, np.int64)
    demand[[690, 670, 683, 1000, 1030, 400, 350]] = [100, 90, 80, 50, 40, 30, 10]
    plan, lower = op13.plan_packing(demand)
    assert lower <= sum(n for _, n in plan) < best_fit(demand)


def test_runs_follow_the_numbers():
    plan = [(((3, 2), (5, 1)), 4), (((3, 1),), 2)]
    p = op13.places(plan)
    assert list(zip(*(p[c].tolist() for c in ("length", "first", "each", "sequence", "offset")), strict=True)) == [(3, 0, 2, 0, 0), (3, 8, 1, 4, 0), (5, 0, 1, 0, 6)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op13_config_packing"](spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = whole(rows, docs, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1
