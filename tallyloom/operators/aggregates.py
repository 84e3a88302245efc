"""Sample, prompt, run: the aggregations of rollout analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(c: Column | str) -> Column:
    """Share of true values among those that aren't null."""
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("double"))


def prompt_rollup(df: DataFrame, keys: list[str], *, acc: str = "acc", score: str = "score", length: str = "length") -> DataFrame:
    """Per prompt: n, pass_count, pass_at_1, best_at_n, strict_rate (score of 1 or more), mean and greatest score, length mean and deviation."""
    strict = (F.col(score) >= 1).cast("double")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(acc).cast("long")).alias("pass_count"), rate(acc).alias("pass_at_1"), F.max(F.col(acc).cast("double")).alias("best_at_n"),
        F.avg(strict).alias("strict_rate"), F.max(strict).alias("strict_any"), F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.min(score).alias("score_min"),
        F.avg(length).alias("length_mean"), F.stddev_pop(length).alias("length_std"),
    )


def votes(df: DataFrame, keys: list[str], *, answer: str = "pred", acc: str = "acc", order: str = "sample_id") -> DataFrame:
    """One row a prompt and answer: n, first place, any correct. What the votes below pick from."""
    return df.groupBy(*keys, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(F.col(acc).cast("int")).alias("any_acc"), F.min_by(F.col(acc).cast("double"), order).alias("first_acc"))


def majority(df: DataFrame, keys: list[str], *, answer: str = "pred", acc: str = "acc", order: str = "sample_id", gold: str | None = None) -> DataFrame:
    """The modal answer of each prompt, null answers only if there are no others, the first on ties.

    maj_any: some sample with the modal answer is correct; maj_first: the first such is;
    maj_gold: the modal answer is the gold one. With them the answers' entropy in bits, its share of
    the greatest possible, and how many differ.
    """
    extra = [gold] if gold else []
    v = votes(df, [*keys, *extra], answer=answer, acc=acc, order=order)
    best = F.struct(F.col(answer).isNotNull().cast("int"), F.col("n"), -F.col("first"))
    valid = F.when(F.col(answer).isNotNull(), F.col("n"))
    total = F.sum(valid)
    # entropy from sums: log2(N) - sum(n log2 n) / N
    entropy = F.when(total > 0, F.log2(total.cast("double")) - F.sum(valid * F.log2(valid.cast("double"))) / total)
    kinds = F.count(valid)
    out = v.groupBy(*keys, *extra).agg(
        F.max_by(answer, best).alias("modal"), F.max_by("any_acc", best).cast("double").alias("maj_any"), F.max_by("first_acc", best).alias("maj_first"),
        entropy.alias("entropy"), (entropy / F.log2(F.greatest(F.lit(2.0), kinds.cast("double")))).alias("entropy_share"), kinds.alias("n_unique"),
    )
    return out.withColumn("maj_gold", (F.col("modal").eqNullSafe(F.col(gold))).cast("double")) if gold else out


def best_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), unbiased; with fewer than k samples whether any is correct."""
    n, c = n.cast("double"), c.cast("double")
    kept = F.lit(1.0)
    for i in range(k):
        kept = kept * F.greatest(n - c - i, F.lit(0.0)) / F.greatest(n - i, F.lit(1.0))
    return F.when(n < k, (c > 0).cast("double")).when(c == 0, 0.0).otherwise(1 - kept)


def support_bin(n: Column, c: Column) -> Column:
    return F.when(c == 0, "zero").when(c == n, "all").otherwise("partial")


def support_bins(per_prompt: DataFrame, keys: list[str], *, n: str = "n", c: str = "pass_count") -> DataFrame:
    """Counts and shares of prompts that none, some or all samples solve."""
    b = per_prompt.withColumn("bin", support_bin(F.col(n), F.col(c)))
    return b.groupBy(*keys).agg(
        F.count("*").alias("n_prompts"), *[F.count_if(F.col("bin") == x).alias(f"{x}_count") for x in ("zero", "partial", "all")], *[rate(F.col("bin") == x).alias(f"{x}_rate") for x in ("zero", "partial", "all")]
    )


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows by value within each group, with their share of the group: one shuffle by key and value, one over the counts."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w))


def entropy_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entropy in bits of a value's distribution, from counts."""
    counts = df.groupBy(*keys, value).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"), F.count("*").alias("n_values"))


def concentration(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Share of rows that have one of the k most frequent values; ties by value."""
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w))
    return counts.groupBy(*keys).agg((F.sum(F.when(F.col("_r") <= k, F.col("n"))) / F.sum("n")).alias("concentration"))


def coupling(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """2 x 2 table of two flags: conditional rates and the phi coefficient (null if a margin is empty)."""
    x, y = F.col(a), F.col(b)
    n11, n10, n01, n00 = (F.count_if(p).cast("double") for p in (x & y, x & ~y, ~x & y, ~x & ~y))
    margins = (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    return df.groupBy(*keys).agg(
        F.try_divide(n11, n11 + n01).alias("p_a_given_b"), F.try_divide(n10, n10 + n00).alias("p_a_given_not_b"), F.try_divide(n11, n11 + n10).alias("p_b_given_a"),
        F.when(margins > 0, (n11 * n00 - n10 * n01) / F.sqrt(margins)).alias("phi"),
    )


def quantile_bins(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Add `bin` from 1: right-closed between exact quantiles of the group, equal edges taken once.

    The edges are a small table, one row a group; the join leaves the choice to Spark.
    """
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("_e"))
    inner = F.filter("_e", lambda e: e < F.col(value))
    return df.join(edges, keys).withColumn("bin", F.greatest(F.lit(1), F.size(inner)).cast("long")).drop("_e")


def two_level(df: DataFrame, prompt: list[str], keys: list[str], value: Column) -> DataFrame:
    """Macro averages: mean, best, worst and strict majority within prompts, then means over prompts."""
    own = df.groupBy(*keys, *prompt).agg(F.avg(value).alias("m"), F.max(value).alias("b"), F.min(value).alias("w"))
    return own.groupBy(*keys).agg(F.count("*").alias("n_prompts"), F.avg("m").alias("mean"), F.avg("b").alias("best"), F.avg("w").alias("worst"), rate(F.col("m") > 0.5).alias("majority"))


def bootstrap_extremes(df: DataFrame, keys: list[str], value: str, sizes: list[int]) -> DataFrame:
    """Expected best and worst of n draws with replacement, in closed form over the ordered values."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(value)).cast("double")
    ranked = df.withColumns({"_i": i, "_n": F.count("*").over(w).cast("double")})
    up = lambda n: F.pow(F.col("_i") / F.col("_n"), F.lit(n)) - F.pow((F.col("_i") - 1) / F.col("_n"), F.lit(n))
    down = lambda n: F.pow((F.col("_n") - F.col("_i") + 1) / F.col("_n"), F.lit(n)) - F.pow((F.col("_n") - F.col("_i")) / F.col("_n"), F.lit(n))
    return ranked.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *[F.sum(F.col(value) * up(n)).alias(f"best_{n}") for n in sizes], *[F.sum(F.col(value) * down(n)).alias(f"worst_{n}") for n in sizes])


def reduce_by_name(metrics: DataFrame, *, name: str = "metric", value: str = "value") -> DataFrame:
    """Names with max take the greatest value, else names with min the least, all others the mean."""
    n = F.col(name)
    return metrics.groupBy(name).agg(F.max(value).alias("_x"), F.min(value).alias("_n"), F.avg(value).alias("_a")).select(name, F.when(n.contains("max"), F.col("_x")).when(n.contains("min"), F.col("_n")).otherwise(F.col("_a")).alias(value))


def aggregate_by_rule(metrics: DataFrame, *, name: str = "metric", value: str = "value", order: str = "seq", weight: str = "weight") -> DataFrame:
    """Reduce by the first rule that the name meets: last, timing sum, average, max, min, sum or total, weighted, else average."""
    n, v = F.col(name), F.col(value)
    aggs = metrics.groupBy(name).agg(
        F.max_by(value, order).alias("last"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.try_divide(F.sum(v * F.col(weight)), F.sum(weight)).alias("weighted")
    )
    chosen = F.when(n.endswith("/last"), F.col("last")).when(n.startswith("timing_s"), F.col("sum"))
    for part, column in (("mean", "avg"), ("avg", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"), ("weighted", "weighted")):
        chosen = chosen.when(n.contains(part), F.col(column))
    return aggs.select(name, chosen.otherwise(F.col("avg")).alias(value))


def z_scores(long: DataFrame, *, metric: str = "metric", value: str = "value") -> DataFrame:
    """Add z: over all rows of a metric, population deviation, 0 deviation as 1; null with fewer than two values."""
    w = Window.partitionBy(metric)
    sd = F.stddev_pop(value).over(w)
    return long.withColumn("z", F.when(F.count(value).over(w) >= 2, (F.col(value) - F.avg(value).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)))


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks from 1, ties share their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation; null below `least` complete pairs or without spread."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = pairs.withColumns({"_x": average_rank(x, keys), "_y": average_rank(y, keys)})
    spread = (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0) & (F.count("*") >= least)
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.when(spread, F.corr("_x", "_y")).alias("rho"))


def kendall(df: DataFrame, keys: list[str], x: str, y: str, order: str) -> DataFrame:
    """Tau-b from signs over the pairs of each group, which must be small (one row a run or step)."""
    a, b = df.alias("a"), df.alias("b")
    on = F.col(f"a.{order}") < F.col(f"b.{order}")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    dx, dy = F.sign(F.col(f"a.{x}") - F.col(f"b.{x}")), F.sign(F.col(f"a.{y}") - F.col(f"b.{y}"))
    pairs = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], dx.alias("dx"), dy.alias("dy"))
    base = F.sqrt(F.sum(F.abs("dx")) * F.sum(F.abs("dy")))
    return pairs.groupBy(*keys).agg(F.when(base > 0, F.sum(F.col("dx") * F.col("dy")) / base).alias("tau"))


def trajectory(df: DataFrame, keys: list[str], step: str, value: str, steps: list[int]) -> DataFrame:
    """Values at given steps side by side, slope of a least-squares line, trapezoid mean, first step over a half."""
    at = [F.max(F.when(F.col(step) == s, F.col(value))) for s in steps]
    area = sum(((at[i] + at[i + 1]) / 2 * (steps[i + 1] - steps[i]) for i in range(len(steps) - 1)), F.lit(0.0)) / (steps[-1] - steps[0])
    usable = (F.count(value) >= 2) & (F.count(value) == F.count("*")) & (F.var_pop(step) > 0)
    return df.groupBy(*keys).agg(*[a.alias(f"at_{s}") for a, s in zip(at, steps, strict=True)], F.when(usable, F.regr_slope(value, step)).alias("slope"), area.alias("trapezoid"), F.min(F.when(F.col(value) > 0.25, F.col(step))).alias("first_over"))


def validation(df: DataFrame, *, source: str, uid: str, value: str) -> DataFrame:
    """Mean, deviation and expected best and worst of 2, 4, .. and N draws per prompt, then means over the prompts of a source."""
    per = df.withColumn("_n", F.count("*").over(Window.partitionBy(source, uid)))
    w = Window.partitionBy(source, uid).orderBy(value)
    grid = F.when(F.col("_n") > 1, F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.pow(F.lit(2), i).cast("long")), lambda x: x < F.col("_n")), F.array(F.col("_n")))))
    ranked = per.withColumn("_i", F.row_number().over(w).cast("double")).withColumn("_k", F.explode_outer(grid))
    n, i, k = F.col("_n").cast("double"), F.col("_i"), F.col("_k")
    up = F.pow(i / n, k) - F.pow((i - 1) / n, k)
    down = F.pow((n - i + 1) / n, k) - F.pow((n - i) / n, k)
    own = ranked.groupBy(source, uid, "_n", "_k").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sum(F.col(value) * up).alias("best"), F.sum(F.col(value) * down).alias("worst"))
    return own.groupBy(source, F.col("_n").alias("n"), F.col("_k").alias("k")).agg(F.count("*").alias("n_prompts"), F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.avg("best").alias("best"), F.avg("worst").alias("worst"))
