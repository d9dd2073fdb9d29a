import math

import pytest
from pyspark.sql import functions as F

from infocausal.functions.special import normal_sf
from infocausal.operators import interventions


def test_inverse_mills(spark):
    zs = [-5.5, -3.0, -1.0, 0.0, 0.5, 2.0, 5.0, 7.0]
    got = [r.m for r in spark.createDataFrame([(z,) for z in zs], "z double").select(interventions.inverse_mills(F.col("z")).alias("m")).collect()]
    assert got == pytest.approx([math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / normal_sf(-z) for z in zs], rel=1e-4)


def test_truncated_factorization_is_adjustment(spark):
    """On z -> t, z -> y, t -> y the product is the back-door formula; a cycle is an error."""
    rows = [(z, t, y) for z in (0, 1) for t in (0, 1) for y in (0, 1) for _ in range(1 + z + 2 * t * z + 3 * y * (1 - z) + t * y)]
    df = spark.createDataFrame(rows, "z int, t int, y int")
    got = {r.y: r.p for r in interventions.truncated_factorization(df, {"z": [], "t": ["z"], "y": ["t", "z"]}, {"t": 1}, "y").collect()}
    want = 0.0
    for z in (0, 1):
        cell = [y for a, t, y in rows if a == z and t == 1]
        want += sum(r[0] == z for r in rows) / len(rows) * sum(cell) / len(cell)
    assert got[1] == pytest.approx(want) and got[0] == pytest.approx(1 - want)
    with pytest.raises(ValueError):
        interventions.truncated_factorization(df, {"z": ["y"], "t": ["z"], "y": ["t"]}, {}, "y")
