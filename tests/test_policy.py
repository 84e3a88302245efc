"""The registry of policy losses, and whom the covariance singles out."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import policy as P


def tokens(spark):
    rows = [(q, t, -0.1 * (q + t + 1), -0.12 * (t + 1), (-1) ** q * 0.5 + 0.1 * t, (q + t) % 4 != 0) for q in range(6) for t in range(1, 8)]
    return rows, spark.createDataFrame(rows, "sequence int, t int, new double, old double, advantage double, mask boolean")


def test_names(spark):
    _, df = tokens(spark)
    for name in P.LOSSES:
        got = P.policy_loss(name, df).collect()
        assert len(got) == 42 and all((r.loss is None) == (not r.mask) for r in got), name
    with pytest.raises(ValueError, match="vanilla"):
        P.policy_loss("none", df)
    with pytest.raises(ValueError, match="taken"):
        P.register("gpg")(lambda d, s: d)


def test_singled_out(spark):
    rows, df = tokens(spark)
    valid = [r for r in rows if r[5]]
    mn, ma = (sum(r[k] for r in valid) / len(valid) for k in (2, 4))
    cov = {(r[0], r[1]): round((r[2] - mn) * (r[4] - ma), 9) for r in valid}
    n = max(1, int(len(valid) * 0.2))
    top = set(sorted(cov, key=lambda k: (-cov[k], k))[:n])
    s = P.Settings(cov_ratio=0.2, cov_low=0.0, cov_high=5.0, kl_coefficient=2.0)
    got = P.policy_loss("kl_cov", df.repartition(5), s).where("mask").collect()
    assert {(r.sequence, r.t) for r in got if r.singled} == top
    for r in got:
        d = r.new - r.old
        assert r.loss == pytest.approx(-r.advantage * math.exp(d) + (2.0 * abs(d) if r.singled else 0))
    got = P.policy_loss("clip_cov", df, s).where("mask").collect()
    hit = [(r.sequence, r.t) for r in got if r.singled]
    assert 0 < len(hit) <= n and all(0 < cov[k] < 5 for k in hit) and all(r.loss == 0 for r in got if r.singled)
    again = P.policy_loss("clip_cov", df.repartition(3), s).where("mask").collect()
    assert sorted(hit) == sorted((r.sequence, r.t) for r in again if r.singled)


def test_first_of_ties(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    got = P.first_of(df, [F.col("k"), F.col("id")], 137, ["id"])
    assert sorted(r.id for r in got.collect()) == list(range(137)) and P.first_of(df.limit(0), [F.col("k")], 5, ["id"]).collect() == []


def test_losses_of_one_pass(spark):
    """All losses as columns of the same rows are what each gives by itself, by one shuffle, and rows up to a cutoff are the first ones."""
    _, df = tokens(spark)
    s = P.Settings(cov_ratio=0.2, cov_low=0.0, cov_high=5.0)
    rows = P.policy_losses(list(P.LOSSES), df, s)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for name in P.LOSSES:
        one = {(r.sequence, r.t): (r.loss, getattr(r, "singled", None)) for r in P.policy_loss(name, df, s).collect()}
        assert one == {(r.sequence, r.t): (r[f"loss_{name}"], r.asDict().get(f"singled_{name}")) for r in rows.collect()}
    odd = spark.createDataFrame([(a, b) for a in (None, 1, 2, 3) for b in (None, 1, 2)], "a int, b int")
    for order in ({"a": True, "b": False}, {"a": False, "b": True}):
        by = [F.desc(c) if down else F.asc(c) for c, down in order.items()]
        for n in (1, 4, 5, 9, 14):
            got = odd.where(P.up_to(order, P.last_of_first(odd, order, n))).collect()
            assert sorted(map(str, got)) == sorted(map(str, odd.orderBy(*by).limit(n).collect()))
    assert odd.where(P.up_to({"a": False}, P.last_of_first(odd.limit(0), {"a": False}, 3))).count() == 0
