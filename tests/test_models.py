import numpy as np
import pytest
from pyspark.sql import functions as F

from infocausal.operators import dependence, discovery, identify, network, propensity, var
from infocausal.sources import tables
from infocausal.streaming import features


def test_var_recovers_coupling(spark):
    rng = np.random.default_rng(3)
    a, x = np.array([[0.5, 0.3], [0.0, 0.5]]), np.zeros((3000, 2))
    for t in range(1, 3000):
        x[t] = a @ x[t - 1] + rng.normal(size=2)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "t long, x double, y double")
    m = var.fit(df, ["x", "y"], 1)
    assert m.n == 2999 and np.allclose(m.a[0], a, atol=0.06) and m.stable()
    assert m.granger("x", "y")[1] < 1e-6 < 0.01 < m.granger("y", "x")[1]
    assert np.allclose(m.responses(3)[0], np.eye(2)) and np.allclose(m.variance_shares(10).sum(1), 1)
    assert np.allclose((m.partial_directed_coherence(0.1) ** 2).sum(0), 1) and (m.coherence(0.2) <= 1 + 1e-9).all()
    assert var.choose_order(df, ["x", "y"], 3) == 1
    assert np.allclose(m.generalized_shares(10).sum(1), 1) and m.generalized_shares(10)[0, 1] > m.generalized_shares(10)[1, 0]
    mean, se = m.forecast(x[-1:], 3)
    assert np.allclose(mean[0], m.intercept() + m.a[0] @ x[-1]) and np.allclose(se[0], np.sqrt(np.diag(m.sigma))) and (np.diff(se, axis=0) > 0).all()
    assert [e[:2] for e in m.causal_edges()] == [("y", "x")]
    parts = m.geweke_parts("x", "y")
    assert parts["y_to_x"] > 0.05 > 0.01 > parts["x_to_y"] >= 0 and parts["total"] == pytest.approx(parts["x_to_y"] + parts["y_to_x"] + parts["instant"])
    # The mean over the frequencies is the causality in time, but for the sample's noise.
    assert m.geweke("x", "y", np.linspace(0, 0.5, 400)).mean() == pytest.approx(parts["y_to_x"], rel=0.1) and (m.geweke("y", "x", np.linspace(0, 0.5, 9)) < 0.02).all()
    assert m.partial_granger("x", "y", []) == pytest.approx(parts["y_to_x"])


def test_partial_granger_takes_out_a_common_input(spark):
    rng = np.random.default_rng(5)
    e, h = rng.normal(size=(4000, 3)), rng.normal(size=4000)
    x = np.zeros((4000, 3))
    for t in range(1, 4000):
        x[t] = 0.5 * x[t - 1] + e[t] + 2 * h[t]
        x[t, 0] += 0.4 * x[t - 1, 1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t long, a double, b double, c double")
    m = var.fit(df, ["a", "b", "c"], 1)
    assert m.partial_granger("a", "b", ["c"]) > 0.05 > 0.01 > abs(m.partial_granger("b", "a", ["c"]))


def test_lags_over_pieces_equal_plain_lags(spark):
    df = spark.range(99_990, 100_020).filter("id != 100005").select(F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    rows = var.lagged(df, ["x"], 2).collect()
    assert sorted(r.x_0 for r in rows) == [t for t in range(99_992, 100_020) if not 100_005 <= t <= 100_007]
    assert all(r.x_0 - r.x_2 == 2 for r in rows)


@pytest.fixture(scope="module")
def confounded(spark):
    u = lambda s: tables.uniform(s, F.col("id"))
    d = spark.range(8000).select("id", tables.normal(1, F.col("id")).alias("x"), u(2).alias("u"), tables.normal(3, F.col("id")).alias("e"))
    d = d.withColumn("t", (F.col("u") < 1 / (1 + F.exp(-F.col("x")))).cast("int"))
    return d.withColumn("y", 2 + 3 * F.col("t") + 2 * F.col("x") + F.col("e")).cache()


def test_propensity_estimators(spark, confounded):
    b = propensity.logistic(confounded, "t", ["x"])
    assert b == pytest.approx([0, 1], abs=0.1)
    e = propensity.score(b, ["x"])
    assert propensity.ipw(confounded, e).first().ate == pytest.approx(3, abs=0.3)
    m1, m0 = propensity.outcome_models(confounded, ["x"])
    assert propensity.doubly_robust(confounded, e, m1, m0).first().ate == pytest.approx(3, abs=0.1)
    assert propensity.stratified(confounded, e, 10).first().ate == pytest.approx(3, abs=0.3)
    assert propensity.cross_fitted(confounded, ["x"], "id").first().effect == pytest.approx(3, abs=0.2)


def test_signed_rank(spark):
    d = [0.5, -1.0, 2.0, 2.0, -2.0, 3.0, 0.0, 4.0]
    got = {r.gamma: r for r in propensity.signed_rank_bounds(spark.createDataFrame([(x,) for x in d], "d double"), [1.0, 2.0]).collect()}
    assert got[1.0].w == 1 + 4 + 4 + 6 + 7
    ranks = np.array([1, 2, 4, 4, 4, 6, 7])
    assert got[1.0].z == pytest.approx((22 - ranks.sum() / 2) / np.sqrt((ranks**2).sum() / 4)) and got[2.0].z < got[1.0].z


def test_networks(spark):
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3)]
    e = spark.createDataFrame(two, "src int, dst int")
    c = {r.node: (r.community, r.settled) for r in network.label_propagation(e).collect()}
    assert all(c[i] == c[0] for i in (0, 1, 2)) and all(c[i] == c[3] for i in (3, 4, 5)) and c[0][1]
    assert network.modularity(e, spark.createDataFrame([(i, i // 3) for i in range(6)], "node int, community int")).first()[0] == pytest.approx(6 / 7 - (4 * 3 + 3 * 4) / 49)
    assert tuple(network.dyads(e.union(spark.createDataFrame([(1, 0)], "src int, dst int"))).first()) == (1, 6)
    assert network.betweenness([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")]) == {"a": 0, "b": 0.5, "c": 0, "d": 0.5}
    assert network.max_flow([("s", "a", 3), ("s", "b", 2), ("a", "t", 2), ("b", "t", 3), ("a", "b", 5)], "s", "t") == 5
    assert network.topological([("b", "c"), ("a", "b")]) == ["a", "b", "c"] and network.topological([("a", "b"), ("b", "a")]) is None
    assert network.path_effect({("z", "x"): 0.8, ("z", "y"): 0.6, ("x", "y"): 0.5}, "z", "y") == pytest.approx(1.0)
    assert network.directed_paths([(0, 1), (1, 2), (0, 2)], 0, 2) == [(0, 1, 2), (0, 2)]


def test_identification():
    front = [("x", "m"), ("m", "y")]
    assert identify.front_door_sets(front, "x", "y", [("x", "y")]) == [("m",)]
    assert identify.identifiable(front, [("x", "y")], "x", "y") and not identify.identifiable([("x", "y")], [("x", "y")], "x", "y")
    assert identify.instruments([("z", "x"), ("x", "y")], "x", "y", [("x", "y")]) == ["z"]
    assert identify.rule_of_exchange([("x", "y")], [], {"y"}, set(), {"x"}, set()) and not identify.rule_of_exchange([("x", "y")], [("x", "y")], {"y"}, set(), {"x"}, set())
    assert identify.rule_of_action([("y", "x")], [], {"y"}, set(), {"x"}, set()) and identify.rule_of_observation([("x", "m"), ("m", "y")], [], {"y"}, set(), {"x"}, {"m"})
    assert identify.districts(["a", "b", "c"], [("a", "b")]) == [frozenset("ab"), frozenset("c")]


def test_recursive_identification():
    same = identify.identifiable
    assert not same([("x", "y")], [("x", "y")], "x", "y")  # bow
    assert same([("x", "m"), ("m", "y")], [("x", "y")], "x", "y")  # front door
    assert same([("w", "r"), ("r", "x"), ("x", "y")], [("w", "x"), ("w", "y")], "x", "y")  # napkin
    assert not same([("w", "x"), ("x", "y")], [("x", "w"), ("y", "w")], "x", "y")  # hedge
    assert same([("z", "x"), ("z", "y"), ("x", "y")], [], "x", "y") and same([("y", "x")], [("x", "y")], "x", "y")
    assert not same([("z", "x"), ("x", "y")], [("x", "y")], "x", "y")  # an instrument alone
    assert same([("x1", "y"), ("x2", "y"), ("x1", "x2")], [("x1", "x2")], {"x1", "x2"}, "y")


def test_csv_rows_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{2 * i}\n" for i in range(3000)))
    (tmp_path / "b.csv").write_text("x,y\n" + "".join(f"{i},{2 * i}\n" for i in range(3000, 5000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = tables.read_series_csv(spark, f"{tmp_path}/*.csv").filter("series = 'x'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted((r.t, r.v) for r in rows) == [(i, float(i)) for i in range(5000)]
    tables.write_doubles(spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0), ("b", 0, None)], "g string, t int, v double"), f"{tmp_path}/p", "g", "t", "v")
    assert sorted((r.group, r.i, str(r.v)) for r in tables.read_packed(spark, f"{tmp_path}/p").collect()) == [("a", 0, "1.0"), ("a", 1, "2.0"), ("b", 0, "None")]


def test_stability_of_a_chain(spark):
    from infocausal.operators import kernels

    d = tables.chain(spark, 800)
    got = {(r.a, r.b): r for r in kernels.edge_stability(d, ["x1", "x2", "x3"], ["i"], 20, alpha=0.001).collect()}
    assert got["x1", "x2"].stability == got["x2", "x3"].stability == 1 and got["x1", "x3"].stability < 0.3
    twice = d.unionByName(d.withColumn("i", F.col("i") + 10_000))
    assert {r.rep: r.n for r in kernels.replicate_moments(twice, ["x1"], ["i"], 3).collect()}.keys() == {1, 2, 3}
    kept = kernels.stable_graph(kernels.edge_stability(d, ["x1", "x2", "x3"], ["i"], 20, alpha=0.001), 2.0).collect()
    assert {(r.a, r.b) for r in kept} == {("x1", "x2"), ("x2", "x3")}


def test_triangles_of_a_hub(spark):
    from infocausal.operators import graph

    e = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39)]
    t = graph.triangles(spark.createDataFrame(e, "src int, dst int")).collect()
    assert len(t) == 38 and {tuple(sorted(r)) for r in t} == {(0, i, i + 1) for i in range(1, 39)}


def test_front_door_of_many_paths():
    inner = "bcdefghijkl"
    edges = [("x", "a"), ("x", "w"), ("w", "y"), *[("a", v) for v in inner], *[(v, "y") for v in inner], *[(u, v) for u in inner for v in inner if u < v]]
    assert identify.front_door_sets(edges, "x", "y", [("x", "y")], most=1) == []
    sets = identify.front_door_sets(edges, "x", "y", [("x", "y")])
    assert sets[0] == ("a", "w") and all("w" in z for z in sets)


def test_separating_set_of_four():
    g = dependence.Gram.__new__(dependence.Gram)
    g.columns, g.n = ["x", "y", "z1", "z2", "z3", "z4"], 10_000
    b = np.vstack([np.ones((2, 4)), np.eye(4)])
    g.cov = b @ b.T + np.diag([1.0, 1, 0, 0, 0, 0])
    edges, sep = discovery.skeleton(g)
    assert edges == {frozenset((v, z)) for v in "xy" for z in g.columns[2:]} and sep[frozenset("xy")] == ("z1", "z2", "z3", "z4")
    assert frozenset("xy") in discovery.skeleton(g, most=3)[0]


def test_effects_over_class(spark):
    g = dependence.Gram(tables.chain(spark, 500), ["x1", "x2", "x3"])
    edges, sep = discovery.skeleton(g)
    arrows = discovery.oriented(["x1", "x2", "x3"], edges, sep)
    got = identify.effects_of_class(arrows, g, "x1", "x2")
    # x2 is the child with no parent but x1, or the cause: the slope alone, or (given x2) none.
    assert len(got) == 2 and got[0] == pytest.approx(g.cov[0, 1] / g.cov[0, 0]) and got[1] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a, b\n# note\n1,2\n\n3,x\n")
    got = {(r.series.strip(), r.v) for r in tables.read_series_csv(spark, f"{tmp_path}/s.csv").collect()}
    assert got == {("a", 1.0), ("b", 2.0), ("a", 3.0), ("b", None)}
    np.arange(5, dtype="<f8").tofile(tmp_path / "x.bin")
    assert [r.v for r in tables.read_doubles(spark, f"{tmp_path}/x.bin").orderBy("i").collect()] == [0, 1, 2, 3, 4]
    long = tables.autoregressive(spark, 2, 50, 0.7).withColumn("series", F.concat(F.lit("s"), "series"))
    tables.write_series_csv(long, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["t", "s0", "s1"]
    m = spark.createDataFrame([("a", 0.0, 2.0), ("b", 1.0, 0.0)], "node string, a double, b double")
    assert {tuple(r) for r in tables.edges_of_matrix(m, "node", ["a", "b"]).collect()} == {("a", "b", 2.0), ("b", "a", 1.0)}
    assert tables.random_graph(spark, 50, 2).filter("src = dst").count() == 0
    assert tables.as_json(m).first().json == '{"node":"a","a":0.0,"b":2.0}'


def test_too_many_series_are_an_error(spark, tmp_path):
    long = spark.range(10_001).select(F.col("id").cast("string").alias("series"), F.lit(0).alias("t"), F.lit(1.0).alias("v"))
    with pytest.raises(ValueError, match="series"):
        tables.write_series_csv(long, f"{tmp_path}/out")


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    whole = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(src, tmp_path / "in" / "e.parquet")
    stream = spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in")
    q = features.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    want = features.windowed(whole)
    assert spark.table("sums").count() == want.count() and spark.table("sums").agg(F.sum("n")).first()[0] == whole.count()
    q = features.smoothed(stream, 0.3).writeStream.outputMode("update").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").agg(F.sum("n")).first()[0] == whole.count()
    seen = []
    sums = want.select("series", "start", "v")
    features.transfer_entropy_sink(4, lambda df, n: seen.append((n, df.count())), lambda: sums.limit(0))(sums, 0)
    assert seen[0][1] > 0


def test_blocked_kernels_equal_whole_matrices():
    from infocausal.functions.special import digamma
    from infocausal.operators import kernels

    rng = np.random.default_rng(8)
    for n in (5, 60, 1300):
        a = np.round(rng.normal(size=n), 1 if n == 60 else 9)
        b = a + rng.normal(size=n)
        d = [np.abs(z[:, None] - z) for z in (a, b)]
        wide = [np.median(x[x > 0]) for x in d]
        assert [kernels.median_distance(z) for z in (a, b)] == pytest.approx(wide)
        k = [np.exp(-(x**2) / (2 * w * w)) for x, w in zip(d, wide, strict=True)]
        c = [x - x.mean(0) - x.mean(1)[:, None] + x.mean() for x in k]
        assert kernels.hsic_statistic(a, b) == pytest.approx((c[0] * c[1]).sum() / n**2)
        joint = np.maximum(*d)
        np.fill_diagonal(joint, np.inf)
        eps = np.partition(joint, 2, axis=1)[:, 2]
        psi = np.vectorize(digamma)
        near = [(x < eps[:, None]).sum(1) - 1 for x in d]
        want = max(digamma(3) + digamma(n) - (psi(np.maximum(near[0], 0) + 1.0) + psi(np.maximum(near[1], 0) + 1.0)).mean(), 0)
        assert kernels.ksg(a, b, 3) == pytest.approx(want)
    assert kernels.median_distance(np.ones(4)) == 1.0
