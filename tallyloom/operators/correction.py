"""How far the policy that was sampled from is from the one that is trained: weights of tokens, and what they come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.losses import clamp

BOUND = 20.0
LEVELS = ("token", "sequence", "geometric")


def log_ratio(ratio: Column, mask: Column, sequence: str, level: str) -> Column:
    """A token's own log-ratio, the sum of its sequence's valid ones, or their mean."""
    if level not in LEVELS:
        raise ValueError(f"no level {level}; there are {', '.join(LEVELS)}")
    if level == "token":
        return ratio
    w, valid = Window.partitionBy(sequence), F.when(mask, ratio)
    return F.coalesce((F.sum(valid) if level == "sequence" else F.avg(valid)).over(w), F.lit(0.0))


def weighted(tokens: DataFrame, ratio: Column, mask: str, sequence: str, *, level: str, most: float | None = None) -> DataFrame:
    """Add `log_ratio` of the level and `weight`, its bounded exponential, cut at `most` if that is given."""
    own = tokens.withColumn("log_ratio", log_ratio(ratio, F.col(mask), sequence, level))
    weight = F.exp(clamp(F.col("log_ratio"), -BOUND, BOUND))
    return own.withColumn("weight", F.least(weight, F.lit(most)) if most is not None else weight)


def weight_metrics(rows: DataFrame, keys: list[str], mask: str, sequence: str, *, level: str, upper: float, lower: float | None = None) -> DataFrame:
    """Per group: mean, greatest, least and deviation of the valid tokens' weights, effective sample size, shares outside the bounds, and the same of sequences.

    lower is 1 / upper unless given. Deviation and sample size are of weights brought within the bounds. Above the token
    level greatest, least and shares are told from the log-ratios of sequences, which aren't bounded below. Sequences are
    summed up before they meet, so a group is as many rows as it has sequences. A group without a valid token has nulls.
    """
    low = 1 / upper if lower is None else lower
    valid, w = F.col(mask), F.col("weight")
    inside = clamp(w, low, upper)
    some = lambda c: F.when(valid, c)
    per = rows.groupBy(*keys, sequence).agg(
        F.count_if(valid).alias("n"), F.sum(some(w)).alias("w"), F.sum(some(inside)).alias("c"), F.sum(some(inside * inside)).alias("q"), F.max(some(w)).alias("x"), F.min(some(w)).alias("m"),
        F.count_if(valid & (w > upper)).alias("h"), F.count_if(valid & (w < low)).alias("l"), F.max("log_ratio").alias("r"),
    ).withColumn("mean", F.coalesce("w", F.lit(0.0)) / (F.col("n") + 1e-8))
    n = F.sum("n")
    mean = lambda c: F.sum(c) / (n + 1e-8)
    share = lambda c: F.avg(c.cast("double"))
    if level == "token":
        high, below, most, least = mean("h"), mean("l"), F.max("x"), F.min("m")
    else:
        high, below = share(F.col("r") > F.log(F.lit(upper))), share(F.col("r") < F.log(F.lit(low)))
        most, least = F.exp(F.least(F.max("r"), F.lit(BOUND))), F.exp(F.min("r"))
    told = lambda c: F.when(n > 0, c)
    own = F.col("mean")
    return per.groupBy(*keys).agg(
        told(mean("w")).alias("mean"), told(most).alias("max"), told(least).alias("min"), told(high).alias("fraction_high"), told(below).alias("fraction_low"),
        told(F.when(n > 1, F.sqrt(F.greatest(mean("q") - mean("c") * mean("c"), F.lit(0.0)))).otherwise(0.0)).alias("std"),
        told(F.pow(mean("c") + 1e-8, F.lit(2)) / mean("q")).alias("eff_sample_size"),
        told(F.avg(own)).alias("seq_mean"), told(F.coalesce(F.stddev_samp(own), F.lit(0.0))).alias("seq_std"), told(F.max(own)).alias("seq_max"), told(F.min(own)).alias("seq_min"),
        told(F.max(F.abs(own - 1))).alias("seq_max_deviation"), told(share(own > upper)).alias("seq_fraction_high"), told(share(own < low)).alias("seq_fraction_low"),
    )
