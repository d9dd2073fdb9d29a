"""Alignment of two tokenizers against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from infocausal.llm import op12_token_alignment as op12
from infocausal.llm.op3_pair_index_bpe import byte_letters
from infocausal.llm.queries import QUERIES
from tests.llm.fixtures import empty, messy

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE = {c: i for i, c in enumerate(byte_letters())}
ODD = [
    " lead", "trail ", "a  b", "a \n b", "tab\tx y", "x  y", "　 z", "▁ under a▁b", "<|endoftext|> <s> <0x41> </s>", "日本語 テキスト です", "ﬁne x́ ꙮ",
    "...!? ,, ;;", "\x00 nul \x1f x", "a" * 700, "don't we'll, they're. OK", "\n\nlines\n\nhere \n", "  ", "\n", "emoji 😀😀 👩‍👩‍👧 ok", "12345 67.89 0x1F", "é é ­ soft", "  line  ",
]


def brute(docs):
    """docs: (id, text) -> rows as tuples, sorted."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    done, total = [], Counter()
    for d, t in docs:
        want = (" " + t).encode() if t else b""
        a = ta.encode(" " + t, add_special_tokens=False) if t else None
        xa = [(i, bytes(BYTE[c] for c in k)) for i, k in zip(a.ids, a.tokens, strict=True)] if t else []
        xb = [(i, bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()) for i in (tb.encode(t) if t else []) for p in [tb.id_to_piece(i)]]
        if b"".join(x for _, x in xa) != want or b"".join(x for _, x in xb) != want:
            xa = xb = []
        spans = []
        for x in (xa, xb):
            at, own = 0, []
            for i, s in x:
                own.append((at, at + len(s), i))
                at += len(s)
            spans.append(own)
        links = sweep(*spans)
        cuts = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        sides = [[], []]
        for side, x in zip(sides, spans, strict=True):
            own = []
            for _, e, i in x:
                own.append(str(i))
                if e in cuts:
                    side.append(",".join(own))
                    own = []
        made = [f"{p}|{q}" for p, q in zip(*sides, strict=True)]
        total.update(links)
        done.append((d, len(xa), len(xb), len(made), links, hashlib.sha256(";".join(made).encode()).hexdigest() if xa else ""))
    top = defaultdict(int)
    for (_, j), n in total.items():
        top[j] = max(top[j], n)
    return sorted(
        [(d, a, b, g, len(ls), sum(total[x] == top[x[1]] for x in ls), sum(total[x] for x in ls), h) for d, a, b, g, ls, h in done], key=str
    )


def sweep(x, y):
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        if max(x[i][0], y[j][0]) < min(x[i][1], y[j][1]):
            out.append((x[i][2], y[j][2]))
        i, j = (i + 1, j) if x[i][1] < y[j][1] else (i, j + 1) if x[i][1] > y[j][1] else (i + 1, j + 1)
    return out


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def rows_of(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()], key=str)


def test_odd_texts(spark):
    rng = random.Random(2)
    docs = list(enumerate(ODD + [None, "", *["".join(rng.choice("ab .,\né▁\t 1😀") for _ in range(rng.randint(1, 40))) for _ in range(150)]]))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, chunk string, n_a int").repartition(3)
    assert rows_of(op12.align_documents(df, A, B)) == brute(docs)


def test_messy_documents_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(op12, "CHUNK_BYTES", 3_000)
    docs = messy(spark)
    short = docs.filter("text is null or length(text) < 6000")
    assert rows_of(op12.align_documents(short, A, B)) == brute([(r["doc_id"], r["text"]) for r in short.collect()])
    assert op12.align_documents(docs, A, B).count() == docs.count()


def test_no_documents(spark):
    assert op12.align_documents(empty(spark), A, B).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id long, text string")
    assert rows_of(op12.align_documents(blank, A, B)) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)], key=str)


def test_ties_share_the_best(spark):
    docs = [(1, "tie"), (2, "tie tie"), (3, "tied")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(op12.align_documents(df, A, B)) == brute(docs)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_token_alignment"](spark, sf)
    assert [c for c in got.columns] == COLUMNS
    assert rows_of(got) == brute(docs)

