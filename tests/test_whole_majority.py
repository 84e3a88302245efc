"""The majority of any number of draws: no number of rows of a prompt is left out."""

import datetime
import math

import duckdb
import pytest

from tallyloom import catalog
from tallyloom.operators import bootstrap as B


@pytest.mark.parametrize("n", [64, 65, 301, 1500])
def test_two_answers_by_the_binomial_law(n):
    law = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.6) + (n - k) * math.log(0.4)) for k in range(n + 1)]
    want = sum(p * (1 if 2 * k > n else 0.5 if 2 * k == n else 0) for k, p in enumerate(law))
    assert B.win_chances([(2, 1), (3, 1)], n) == pytest.approx([1 - want, want], abs=1e-9)


def test_many_draws_and_answers():
    classes = [(1, 20), (2, 10), (30, 2), (100, 1)]
    assert sum(m * p for (_, m), p in zip(classes, B.win_chances(classes, 200), strict=True)) == pytest.approx(1.0, abs=1e-9)
    assert B.win_chances([(5, 40)], 200) == pytest.approx([1 / 40], abs=1e-12)


def test_prompts_of_many_rows_as_in_sql(spark, tmp_path):
    """One prompt of 70 rows beside small ones."""
    sizes = {1: 70, 2: 3, 3: 1, 4: 33}
    lines = [(o, k, k * 3 + o, k * 7 % 40, float(k), 0.01 * (k % 11), 0.01 * (k % 9), "A", "O", float(k), datetime.date(1995, 1, 1 + k % 9)) for o, n in sizes.items() for k in range(n)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, "F", datetime.date(1995, 1, 1)) for o in sizes], "o_orderkey bigint, o_orderstatus string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["a52_majority_of_draws"](spark, str(tmp_path)).orderBy("n", "k").select("run_name", "n", "k", "n_prompts", "maj", "maj_std").collect())
    assert [(r[1], r[2]) for r in got] == [(3, 2), (3, 3), *((33, k) for k in (2, 4, 8, 16, 32, 33)), *((70, k) for k in (2, 4, 8, 16, 32, 64, 70))]
    assert got == sorted(c.execute(f"SELECT run_name, n, k, n_prompts, maj, maj_std FROM ({catalog.ORACLES['a52_majority_of_draws']})").fetchall())
