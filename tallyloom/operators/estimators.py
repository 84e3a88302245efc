"""Group-relative advantage estimators, as window expressions over one row a response or a token."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESTIMATORS: dict[str, Callable[..., Column]] = {}


def estimator(name: str):
    """Register a builder; a second one of the same name is an error unless it is the same."""

    def add(f):
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} exists")
        ESTIMATORS[name] = f
        return f

    return add


def _group(group: str):
    return Window.partitionBy(group)


@estimator("grpo")
def grpo(score: str, group: str, *, by_std: bool = True, eps: float = 1e-6) -> Column:
    """(score - mean) / (sample deviation + eps); a group of one has mean 0 and deviation 1."""
    w = _group(group)
    alone = F.count("*").over(w) == 1
    centred = F.col(score) - F.when(alone, 0.0).otherwise(F.avg(score).over(w))
    return centred / (F.when(alone, 1.0).otherwise(F.stddev_samp(score).over(w)) + eps) if by_std else centred


@estimator("grpo_vectorized")
def grpo_floored(score: str, group: str, *, eps: float = 1e-6) -> Column:
    """As grpo, with the variance at least eps."""
    w = _group(group)
    alone = F.count("*").over(w) == 1
    mean = F.when(alone, 0.0).otherwise(F.avg(score).over(w))
    return (F.col(score) - mean) / (F.when(alone, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(eps)))) + eps)


@estimator("grpo_passk")
def grpo_passk(score: str, group: str, order: str, *, by_std: bool = False, eps: float = 1e-6) -> Column:
    """The best response (the first on ties) gets its lead over the second, all others nothing; groups of one are an error."""
    w = _group(group)
    ranked = w.orderBy(F.desc(score), order)
    lead = F.col(score) - F.lead(score).over(ranked)
    value = F.when(F.row_number().over(ranked) == 1, lead).otherwise(0.0)
    value = value / (F.stddev_samp(score).over(w) + eps) if by_std else value
    return F.when(F.count("*").over(w) >= 2, value).otherwise(F.raise_error(F.lit("a group needs two responses")).cast("double"))


@estimator("rloo")
def rloo(score: str, group: str) -> Column:
    """n / (n - 1) (score - mean); a group of one stays as it is."""
    w = _group(group)
    n = F.count("*").over(w)
    return F.when(n > 1, n / (n - 1) * (F.col(score) - F.avg(score).over(w))).otherwise(F.col(score))


@estimator("rloo_vectorized")
def rloo_zero(score: str, group: str) -> Column:
    """(n score - sum) / max(n - 1, 1): a group of one gets 0."""
    w = _group(group)
    n = F.count("*").over(w)
    return (n * F.col(score) - F.sum(score).over(w)) / F.greatest(n - 1, F.lit(1))


@estimator("opo")
def opo(score: str, group: str, length: str) -> Column:
    """score less the mean weighted by length; 0 for a group of one."""
    w = _group(group)
    base = F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w)
    return F.col(score) - F.when(F.count("*").over(w) > 1, base).otherwise(0.0)


@estimator("reinforce_plus_plus_baseline")
def centred(score: str, group: str) -> Column:
    """score less the group's mean, 0 for a group of one; whitened over all afterwards."""
    w = _group(group)
    return F.col(score) - F.when(F.count("*").over(w) > 1, F.avg(score).over(w)).otherwise(0.0)


def gpg(df: DataFrame, score: str, group: str, *, scale: float = 1.0) -> DataFrame:
    """Add advantage: alpha (score - mean) / scale, alpha being rows over rows with a score other than 0."""
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    return df.crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("_alpha") * centred(score, group) / scale).drop("_alpha")


def whiten(df: DataFrame, value: str, mask: str | None = None, *, shift: bool = True, eps: float = 1e-8) -> DataFrame:
    """value less its mean, over its deviation (sample variance), both over masked rows; one row is sent to all."""
    v = F.when(F.col(mask), F.col(value)) if mask else F.col(value)
    stats = df.agg(F.avg(v).alias("_m"), F.var_samp(v).alias("_v"))
    out = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)
    return df.crossJoin(F.broadcast(stats)).withColumn(value, out if shift else out + F.col("_m")).drop("_m", "_v")


def returns_to_go(value: str, sequence: str, t: str) -> Column:
    """Sum from this token to the end of its sequence."""
    return F.sum(value).over(Window.partitionBy(sequence).orderBy(t).rowsBetween(Window.currentRow, Window.unboundedFollowing))


def token_grpo(df: DataFrame, reward: str, group: str, sequence: str, t: str, mask: str, *, eps: float = 1e-6) -> DataFrame:
    """Add advantage: rewards of valid tokens normalised over the group, then summed to the end of the sequence."""
    w = _group(group)
    valid = F.when(F.col(mask), F.col(reward))
    alone = F.count(valid).over(w) <= 1
    z = (F.col(reward) - F.when(alone, 0.0).otherwise(F.avg(valid).over(w))) / (F.when(alone, 1.0).otherwise(F.stddev_samp(valid).over(w)) + eps)
    return df.withColumn("_z", F.when(F.col(mask), z).otherwise(0.0)).withColumn("advantage", returns_to_go("_z", sequence, t)).drop("_z")


def vectors(df: DataFrame, sequence: str, t: str, *columns: str) -> DataFrame:
    """One row a sequence, its columns as arrays in token order."""
    every = F.array_sort(F.collect_list(F.struct(t, *columns)))
    return df.groupBy(sequence).agg(every.alias("_x")).select(sequence, *[F.col(f"_x.{c}").alias(c) for c in columns])


def discounted(reward: Column, mask: Column, gamma: float) -> Column:
    """From the end: R = r + gamma R, then R times the mask of the token; an array. One pass over each sequence, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def scan(rewards: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for r, m in zip(rewards, masks, strict=True):
            own, held = np.empty(len(r)), 0.0
            for i in range(len(r) - 1, -1, -1):
                own[i] = float(r[i]) + gamma * held
                held = own[i] * bool(m[i])
            out.append(own)
        return pd.Series(out)

    return scan(reward, mask)


def gae(reward: Column, value: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening; tokens outside the mask pass on what came after them. One pass over each sequence, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def scan(rewards: pd.Series, values: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for r, v, m in zip(rewards, values, masks, strict=True):
            own, after, held = np.empty(len(r)), 0.0, 0.0
            for i in range(len(r) - 1, -1, -1):
                if m[i]:
                    held = float(r[i]) + gamma * after - float(v[i]) + gamma * lam * held
                    after = float(v[i])
                own[i] = held
            out.append(own)
        return pd.Series(out)

    return scan(reward, value, mask)


def filter_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies, and of groups of one."""
    w = _group(group)
    keep = (F.stddev_pop(metric).over(w) > 0) | (F.count("*").over(w) == 1)
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def loss(df: DataFrame, value: str, mask: str, sequence: str, mode: str, *, norm: float = 1.0) -> DataFrame:
    """One number: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    v = F.when(F.col(mask), F.col(value))
    if mode == "token-mean":
        return df.agg((F.sum(v) / F.count(v)).alias("loss"))
    if mode not in ("seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        raise ValueError(mode)
    own = df.groupBy(sequence).agg(F.sum(v).alias("s"), F.count(v).alias("n")).where("n > 0")
    if mode == "seq-mean-token-sum-norm":
        return own.agg((F.sum("s") / norm).alias("loss"))
    return own.agg(F.avg("s" if mode == "seq-mean-token-sum" else F.col("s") / F.col("n")).alias("loss"))


def direct(reward: str, mask: str) -> Column:
    """A token's reward where it counts, else 0; of several rewards a token each."""
    return F.when(F.col(mask), F.col(reward)).otherwise(F.lit(0.0))


def direct_plus_grpo(df: DataFrame, reward: str, true_reward: str, group: str, sequence: str, mask: str, *, weight: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Add advantage: direct(), and the weighted group-relative advantage of the sequence's summed true rewards on tokens that count."""
    sums = df.groupBy(group, sequence).agg(F.sum(true_reward).alias("_s"))
    own = sums.select(F.col(group).alias("_g"), F.col(sequence).alias("_q"), grpo("_s", group, eps=eps).alias("_a"))
    joined = df.join(own, df[group].eqNullSafe(own["_g"]) & df[sequence].eqNullSafe(own["_q"]))
    return joined.withColumn("advantage", direct(reward, mask) + F.when(F.col(mask), weight * F.col("_a")).otherwise(0.0)).drop("_g", "_q", "_a")


def masked_rloo(df: DataFrame, reward: str, mask: str, group: str, sequence: str, out: str) -> DataFrame:
    """Add leave-one-out rewards of masked tokens: r * n / (n - 1) less the sum of the sequences' mean rewards over n - 1; others 0.

    n is how many sequences the group has; a group of one has null, as there is nothing to leave out.
    """
    means = df.groupBy(group, sequence).agg(F.avg(F.when(F.col(mask), F.col(reward))).alias("_m"))
    sums = means.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.sum("_m").alias("_s"))
    joined = df.join(sums, df[group].eqNullSafe(sums["_g"]))
    rest = F.when(F.col("_n") > 1, F.col("_n") - 1)
    return joined.withColumn(out, F.when(F.col(mask), F.col(reward) * F.col("_n") / rest - F.col("_s") / rest).when(rest.isNotNull(), 0.0)).drop("_g", "_n", "_s")


def rloo_of_sources(df: DataFrame, sources: dict[str, tuple[str, str, float]], group: str, sequence: str, t: str, mask: str) -> DataFrame:
    """Add returns and advantage of several reward sources, each (reward, its mask, coefficient) by masked_rloo().

    The weighted sum is summed to the end of the sequence over tokens that count, then whitened over them. A coefficient
    of 0 leaves its source out.
    """
    total, own = F.lit(0.0), df
    for name, (reward, own_mask, weight) in sources.items():
        if weight:
            own = masked_rloo(own, reward, own_mask, group, sequence, f"_{name}")
            total = total + weight * F.col(f"_{name}")
    own = own.withColumn("_r", F.when(F.col(mask), total).otherwise(0.0)).withColumn("returns", returns_to_go("_r", sequence, t))
    kept = [c for c in own.columns if c != "_r" and c not in {f"_{n}" for n in sources}]
    return whiten(own.select(*kept).withColumn("advantage", F.col("returns")), "advantage", mask)


def plus_plus(df: DataFrame, reward: str, sequence: str, t: str, mask: str, *, gamma: float) -> DataFrame:
    """sequence, t, returns and advantage: returns discounted from the end, starting anew before tokens that don't count, whitened over those that do; 0 elsewhere."""
    v = vectors(df, sequence, t, reward, mask).withColumn("_r", discounted(F.col(reward), F.col(mask), gamma))
    order = df.groupBy(sequence).agg(F.array_sort(F.collect_list(t)).alias("_t"))
    zipped = v.join(order, sequence).select(sequence, F.explode(F.arrays_zip("_t", "_r", mask)).alias("_z"))
    rows = zipped.select(sequence, F.col("_z._t").alias(t), F.col("_z._r").alias("returns"), F.col(f"_z.{mask}").alias(mask)).withColumn("advantage", F.col("returns"))
    return whiten(rows, "advantage", mask).withColumn("advantage", F.when(F.col(mask), F.col("advantage")).otherwise(0.0))


def remax(df: DataFrame, reward: str, baselines: DataFrame, baseline: str, sequence: str, t: str, mask: str) -> DataFrame:
    """Add returns (of tokens that count, to the end of the sequence) and advantage: less the sequence's baseline on tokens that count. A sequence without a baseline has 0."""
    own = baselines.select(F.col(sequence).alias("_q"), F.col(baseline).alias("_b"))
    joined = df.join(own, df[sequence] == own["_q"], "left").withColumn("_r", F.when(F.col(mask), F.col(reward)).otherwise(0.0))
    out = joined.withColumn("returns", returns_to_go("_r", sequence, t))
    return out.withColumn("advantage", F.col("returns") - F.when(F.col(mask), F.coalesce("_b", F.lit(0.0))).otherwise(0.0)).drop("_q", "_b", "_r")


def position_means(df: DataFrame, t: str, mask: str, values: list[str]) -> DataFrame:
    """Means by position over tokens that count, and how many they are; positions without one don't appear."""
    return df.where(F.col(mask)).groupBy(t).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
