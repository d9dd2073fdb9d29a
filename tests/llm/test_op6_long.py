"""Long labelled texts are learned from, and which rows are sampled doesn't depend on their order."""

import numpy as np
from pyspark.sql import functions as F

from infocausal.llm import op6_ecoc_langid as op6


def test_long_texts_teach_their_language(spark):
    rows = [(i, "the house and the tree of the garden " * 5 + str(i), "en") for i in range(50)] + [(100 + i, "la casa y el árbol del jardín con " * 1500 + str(i), "es") for i in range(50)]
    model = op6.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("en", "es")
    asked = spark.createDataFrame([(1, "el jardín y la casa con el árbol"), (2, "the garden and the house"), (3, "la casa del jardín " * 30_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in op6.predict(asked, model, keep=(F.col("doc_id"),)).collect()} == {1: "es", 2: "en", 3: "es"}


def test_equal_ids_give_one_model(spark, monkeypatch):
    monkeypatch.setattr(op6, "SAMPLE_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(None, "".join(rng.choice(list("abcde "), 40)), "x") for _ in range(200)] + [(None, "".join(rng.choice(list("vwxyz "), 40)), "y") for _ in range(200)]
    one, two = (op6.learn(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)) for r, n in ((rows, 1), (rows[::-1], 7)))
    assert one is not None and (one.weights == two.weights).all()
