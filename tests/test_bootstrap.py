"""Draws with replacement against closed forms and enumeration, spectra against a plain decomposition."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import bootstrap as B
from tallyloom.operators import spectrum as P


def enumerated(counts, n):
    """By every sequence of draws."""
    pool = [a for a, c in enumerate(counts) for _ in range(c)]
    wins = Counter()
    for drawn in itertools.product(pool, repeat=n):
        votes = Counter(drawn)
        wins[max(votes, key=votes.get)] += 1
    return [wins[a] / len(pool) ** n for a in range(len(counts))]


@pytest.mark.parametrize("counts", [[1], [3, 1], [2, 2], [1, 1, 1], [4, 2, 1], [2, 2, 1, 1]])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_chances_of_winning(counts, n):
    classes = sorted(Counter(counts).items())
    chance = dict(zip([c for c, _ in classes], B.win_chances(classes, n), strict=True))
    assert [chance[c] for c in counts] == pytest.approx(enumerated(counts, n))
    large = B.win_chances([(1, 500), (7, 40), (300, 2)], 64)
    assert 500 * large[0] + 40 * large[1] + 2 * large[2] == pytest.approx(1.0)


def test_majority_columns(spark):
    rows = [("s", 1, "A", 0.9), ("s", 1, "B", 0.8), ("s", 1, "A", 0.7), ("s", 2, None, 1.0), ("s", 2, "A", 0.0), ("s", 3, "A", 5.0), *(("hot", 1, str(k % 9), float(k % 9)) for k in range(300))]
    df = spark.createDataFrame(rows, "source string, uid int, pred string, score double")
    got = {(r.source, r.n, r.k): r for r in B.majority_of_draws(df, source="source", uid="uid", vote="pred", value="score").collect()}
    assert set(got) == {("s", 3, 2), ("s", 3, 3), ("s", 2, 2), *(("hot", 300, k) for k in (2, 4, 8, 16, 32, 64, 128, 256, 300))}
    data = [("A", 0.9), ("B", 0.8), ("A", 0.7)]
    for n in (2, 3):
        values = []
        for drawn in itertools.product(data, repeat=n):
            by = defaultdict(list)
            for p, v in drawn:
                by[p].append(v)
            values.append(by[max(by, key=lambda p: len(by[p]))][0])
        assert (got["s", 3, n].maj, got["s", 3, n].maj_std) == pytest.approx((np.mean(values), np.std(values)))
    assert got["s", 2, 2].maj == pytest.approx(0.5) and got["hot", 300, 300].maj is None and got["hot", 300, 64].maj > 0


def test_bootstrap_meets_closed_forms(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.random()) for g, n in (("a", 1), ("b", 5), ("c", 700), (None, 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v double")

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    got = {r.g: r for r in B.bootstrap(df.repartition(1), ["g"], ["k"], 4, {"best": F.max("v"), "worst": F.min("v")}, replicates=400).collect()}
    again = {r.g: r for r in B.bootstrap(df.repartition(7), ["g"], ["k"], 4, {"best": F.max("v"), "worst": F.min("v")}, replicates=400).collect()}
    assert {g: pytest.approx(tuple(r)[1:]) for g, r in got.items()} == {g: tuple(r)[1:] for g, r in again.items()} and set(got) == {"a", "b", "c", None}
    for g in got:
        v = sorted(x for h, _, x in rows if h == g)
        n = len(v)
        best = sum(x * (((i + 1) / n) ** 4 - (i / n) ** 4) for i, x in enumerate(v))
        worst = sum(x * (((n - i) / n) ** 4 - ((n - i - 1) / n) ** 4) for i, x in enumerate(v))
        for mean, std, want in ((got[g].best_mean, got[g].best_std, best), (got[g].worst_mean, got[g].worst_std, worst)):
            assert abs(mean - want) <= 3.5 * std / math.sqrt(400) + 1e-9
    ranges = B.bootstrap(df, ["g"], ["k"], 4, {"spread": spread(F.col("v"))}, replicates=20).collect()
    assert all(r.spread_mean >= 0 for r in ranges) and len(ranges) == 4
    with pytest.raises(ValueError, match="positive"):
        B.bootstrap(df, ["g"], ["k"], 0, {"best": F.max("v")})
    assert B.bootstrap(df.limit(0), ["g"], ["k"], 2, {"best": F.max("v")}).collect() == []


def test_spectrum(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(200, 12)) @ np.diag(np.linspace(3, 0.1, 12))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)] + [(999, None)], "id int, v array<double>").repartition(5)
    sigma, vectors = P.eigenpairs(P.gram(df, "v"))
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert sigma == pytest.approx(s, abs=1e-6)
    table = P.scree(sigma, 5)
    assert [r[3] for r in table] == pytest.approx(list(s[:5] ** 2 / (s**2).sum()), abs=1e-6) and table[4][4] == pytest.approx((s[:5] ** 2).sum() / (s**2).sum())
    for r in P.cosines(df, "id", "v", sigma, vectors, 3).collect():
        assert abs(r.cosine) == pytest.approx(abs(u[r.id, r.component - 1]), abs=1e-6)
    zero = P.difference(df, df, "id", "v")
    sigma, vectors = P.eigenpairs(P.gram(zero, "v"))
    assert P.scree(sigma, 3) == [] and P.cosines(zero, "id", "v", sigma, vectors, 3).collect() == []
    assert P.scree(P.eigenpairs(P.gram(df.limit(0), "v"))[0], 3) == []
