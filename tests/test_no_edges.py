"""Queries over trade where no pair of nations is a tenth over the mean, as in large tables."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from infocausal.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import connect

NATIONS = 3


@pytest.fixture(scope="module")
def even(tmp_path_factory):
    d = tmp_path_factory.mktemp("even")
    pairs = [(a, b) for a in range(NATIONS) for b in range(NATIONS)]
    n = len(pairs)
    ids = lambda of, kind="int64": pa.array(of, kind)
    made = {
        "customer": {"c_custkey": ids(range(NATIONS)), "c_nationkey": ids(range(NATIONS), "int32")},
        "supplier": {"s_suppkey": ids(range(NATIONS)), "s_nationkey": ids(range(NATIONS), "int32")},
        "orders": {"o_orderkey": ids(range(n)), "o_custkey": ids([a for a, _ in pairs])},
        "lineitem": {"l_orderkey": ids(range(n)), "l_suppkey": ids([b for _, b in pairs])},
    }
    for name in "region nation part events documents embeddings pages benchmark labels conversations".split():
        made[name] = {"x": ids([])}
    for name, columns in made.items():
        pq.write_table(pa.table(columns), d / f"{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["reciprocity", "path_summary", "degrees", "distances", "clustering", "degree_entropy", "closeness", "bifans", "feed_forward_loops", "page_rank"])
def test_trade_without_edges(spark, even, name):
    want = connect(even).execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, even).toPandas()
    plain = lambda d: sorted(tuple(None if v != v else v for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
