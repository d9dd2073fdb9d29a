import hashlib

import corpus_pipeline
import pytest

from infocausal.llm import queries
from tests.llm.fixtures import words
from tests.llm.test_operators import brute_classes, brute_overlaps, brute_repeats, plain_counts, tokenizer
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_stages_equal_brute_force(spark, tmp_path):
    import random

    rng = random.Random(6)
    base = [words(rng, 80) for _ in range(20)]
    bench = [(i, words(rng, 25)) for i in range(3)]
    text = [*base, base[0], base[1].replace(base[1].split()[40], "other"), "short one", None, "", base[2][:150] + " " + words(rng, 60), words(rng, 40) + " " + bench[1][1] + " " + words(rng, 40)]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(text)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, t) for i, t, *_ in rows if (c := plain_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    classes = brute_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i] == i]
    cut = brute_repeats(docs)
    docs = [(i, cut[i][2].decode(errors="ignore")) for i, _ in docs]
    bad = {i for i, _ in brute_overlaps(docs, bench)}
    lib = tokenizer("word_bpe_49k.json")
    want = {}
    for i, t in docs:
        if i not in bad:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and bad and len(want) >= 20
