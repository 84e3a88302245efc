"""Rounding at ties as SQL does."""

import duckdb

from tallyloom.plans.registry import scaled_round


def test_scaled_round_is_that_of_sql(spark):
    values = [a / 100 * 0.9**k + b / 100 * 0.9**j for a in range(11) for b in range(11) for k in range(4) for j in range(4, 7)]
    values += [-v for v in values]
    own = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scaled_round("v", 5).alias("r"))
    sql = duckdb.execute("SELECT round(v, 5) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()
    assert [r.r + 0.0 for r in own.orderBy("i").collect()] == [r[0] + 0.0 for r in sql]
