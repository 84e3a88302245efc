"""Queries on draws with replacement and on spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import bootstrap as B
from tallyloom.operators import spectrum as P
from tallyloom.sources import views as V

from .registry import query

_COUNTS = "SELECT run_name, prompt_id, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (coalesce(pred, '') = '{a}') AS n{i}, coalesce(avg(score) FILTER (coalesce(pred, '') = '{a}'), 0) AS v{i}, coalesce(avg(score * score) FILTER (coalesce(pred, '') = '{a}'), 0) AS w{i}" for i, a in enumerate(("", "a0", "a1", "a2"))
) + " FROM v_rollouts GROUP BY ALL"
_TOP, _TIES = "greatest(c0, c1, c2, c3)", "(" + " + ".join(f"(c{i} = greatest(c0, c1, c2, c3))::INT" for i in range(4)) + ")"
_CHANCE = "exp(lgamma(k + 1) + " + " + ".join(f"CASE WHEN c{i} > 0 THEN c{i} * ln(n{i}::DOUBLE / n) - lgamma(c{i} + 1) ELSE 0 END" for i in range(4)) + ")"


@query("a52_majority_of_draws", f"""WITH p AS ({_COUNTS}), g AS (SELECT *, unnest(list_distinct(list_filter(list_transform(range(1, 41), lambda i: 1::BIGINT << i::INT), lambda x: x < n) || [n])) AS k FROM p WHERE n > 1),
    h AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM p))) AS c),
    e AS (SELECT a.c AS c0, b.c AS c1, c.c AS c2, d.c AS c3 FROM h a, h b, h c, h d WHERE a.c + b.c + c.c + d.c BETWEEN 2 AND (SELECT max(n) FROM p)),
    m AS (SELECT run_name, prompt_id, n, k, {', '.join(f"sum({_CHANCE} * ({' + '.join(f'(c{i} = {_TOP})::INT * {x}{i}' for i in range(4))}) / {_TIES}) AS {x}" for x in 'vw')}
        FROM g JOIN e ON c0 + c1 + c2 + c3 = k AND {' AND '.join(f'(n{i} > 0 OR c{i} = 0)' for i in range(4))} GROUP BY ALL)
    SELECT run_name, n, k, count(*) AS n_prompts, round(avg(v), 6) AS maj, round(avg(sqrt(greatest(w - v * v, 0))), 6) AS maj_std FROM m GROUP BY ALL""", exact=True)
def a52(spark, d):
    return B.majority_of_draws(V.rollouts(spark, d), source="run_name", uid="prompt_id", vote="pred", value="score", most=None)


_INDEX = "SELECT run_name, checkpoint_step, score, prompt_id, sample_id, row_number() OVER (PARTITION BY run_name, checkpoint_step ORDER BY substr(md5(prompt_id || ':' || sample_id), 1, 2), prompt_id, sample_id) - 1 AS i, count(*) OVER (PARTITION BY run_name, checkpoint_step) AS n FROM v_rollouts"
_DRAWN = f"""WITH r AS ({_INDEX}), g AS (SELECT DISTINCT run_name, checkpoint_step, n FROM r),
    d AS (SELECT run_name, checkpoint_step, b.range AS b, j.range AS j, ('0x' || substr(md5('42:' || run_name || ':' || checkpoint_step || ':' || b.range || ':' || j.range), 1, 12))::BIGINT % n AS i FROM g, range(1, 201) b, range(1, 17) j),
    x AS (SELECT run_name, checkpoint_step, b, max(score) AS best, min(score) AS worst, quantile_cont(score, 0.5) AS middle, arg_min(score, j) AS first FROM d JOIN r USING (run_name, checkpoint_step, i) GROUP BY ALL)"""


@query("a53_bootstrap", f"{_DRAWN} SELECT run_name, checkpoint_step, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("best", "worst", "middle", "first")) + " FROM x GROUP BY ALL", exact=True)
def a53_d13(spark, d):
    """200 replicates of 16 draws, with the reducers max, min, median and first drawn."""
    reducers = {"best": F.max("score"), "worst": F.min("score"), "middle": F.percentile("score", F.lit(0.5)), "first": F.min_by("score", "draw")}
    return B.bootstrap(V.rollouts(spark, d), ["run_name", "checkpoint_step"], ["prompt_id", "sample_id"], 16, reducers, replicates=200)


def _changes(spark, d):
    """Vectors less those of the id before, as the change of weights between two states."""
    v = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    return P.difference(v.withColumn("vec_id", F.col("vec_id") + 1), v, "vec_id", "embedding")


_DELTA = "SELECT b.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE) AS x FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id"


@query("a75_gram", f"WITH d AS ({_DELTA}), n AS (SELECT max(len(x)) AS n FROM d) SELECT i.range AS i, j.range AS j, round(sum(x[i.range + 1] * x[j.range + 1]), 6) AS x FROM d, n, range(n) i, range(n) j WHERE i.range <= 7 AND j.range <= i.range GROUP BY ALL", exact=True)
def a75_gram(spark, d):
    return P.gram(_changes(spark, d), "embedding").where("i <= 7 AND j <= i")


@query("a75_spectrum")
def a75(spark, d):
    sigma, _ = P.eigenpairs(P.gram(_changes(spark, d), "embedding"))
    return spark.createDataFrame(P.scree(sigma, 32), "component int, sigma double, sigma_over_fro double, var_fraction double, cum_var_fraction double")


@query("a75_cosines")
def a75_cosines(spark, d):
    rows = _changes(spark, d)
    return P.cosines(rows, "vec_id", "embedding", *P.eigenpairs(P.gram(rows, "embedding")), 3)
