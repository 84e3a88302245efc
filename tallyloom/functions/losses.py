"""Row-wise losses, penalties and importance weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kl_penalty(a: Column, b: Column, kind: str) -> Column:
    """Estimates of a divergence from two log-probabilities: k1, abs, k2 (mse) or k3 (low variance)."""
    d = a - b
    if kind == "k1":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "k2":
        return 0.5 * d * d
    if kind == "k3":
        x = clamp(b - a, -20.0, 20.0)
        return clamp(F.exp(x) - x - 1, -10.0, 10.0)
    raise ValueError(kind)


def importance_weight(old: Column, rollout: Column, *, bound: float = 20.0, most: float = 2.0) -> Column:
    return F.least(F.exp(clamp(old - rollout, -bound, bound)), F.lit(most))


def rejected(weight: Column, upper: float, lower: float | None = None) -> Column:
    """Outside lower .. upper; lower is 1 / upper unless given."""
    return ~weight.between(1 / upper if lower is None else lower, upper)


def policy_loss(new: Column, old: Column, advantage: Column, *, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped surrogate with a dual clip for negative advantages."""
    ratio = F.exp(clamp(new - old, -20.0, 20.0))
    worst = F.greatest(-advantage * ratio, -advantage * clamp(ratio, 1 - low, 1 + high))
    return F.when(advantage < 0, F.least(-advantage * dual, worst)).otherwise(worst)


def value_loss(value: Column, old: Column, returns: Column, clip: float) -> Column:
    kept = F.least(F.greatest(value, old - clip), old + clip)
    return 0.5 * F.greatest(F.pow(value - returns, 2), F.pow(kept - returns, 2))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float) -> Column:
    """Zero up to limit - buffer, falling to -factor at the limit and on beyond it."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def workload(length: Column) -> Column:
    """Cost of a sequence: linear and attention terms."""
    return 24576 * length + length * length


def signed_log10(x: Column) -> Column:
    return F.when(x != 0, F.sign(x) * F.log10(F.abs(x)))


def bounded_ratio(new: Column, old: Column, bound: float = 20.0) -> Column:
    return F.exp(clamp(new - old, -bound, bound))


def sequence_ratio(new: str, old: str, mask: str, window) -> Column:
    """The geometric mean of a sequence's valid token ratios, on each of its rows."""
    return F.exp(clamp(F.avg(F.when(F.col(mask), F.col(new) - F.col(old))).over(window), -20.0, 20.0))


def clipped(ratio: Column, advantage: Column, low: float, high: float) -> Column:
    return F.greatest(-advantage * ratio, -advantage * clamp(ratio, 1 - low, 1 + high))


def geometric_policy_loss(new: str, old: str, advantage: Column, mask: str, window, clip: float = 0.4) -> Column:
    """Per sequence: token log-ratios are clipped against the advantage's sign, averaged, and weigh the advantage."""
    d = F.col(new) - F.col(old)
    sign = F.signum(advantage)
    kept = sign * F.least(sign * d, sign * clamp(d, -clip, clip))
    return -advantage * F.exp(F.avg(F.when(F.col(mask), kept)).over(window))


def covariance_clipped(df, new: str, old: str, advantage: str, mask: str, *, low: float, high: float, clip: float = 0.2):
    """Clipped surrogate; tokens whose log-probability and advantage vary together between `low` and `high` teach nothing. Adds cov and loss."""
    valid = F.col(mask)
    every = df.agg(F.avg(F.when(valid, F.col(new))).alias("_mn"), F.avg(F.when(valid, F.col(advantage))).alias("_ma"))
    out = df.join(F.broadcast(every), how="cross").withColumn("cov", (F.col(new) - F.col("_mn")) * (F.col(advantage) - F.col("_ma")))
    full = clipped(bounded_ratio(F.col(new), F.col(old)), F.col(advantage), clip, clip)
    return out.withColumn("loss", F.when(valid, F.when((F.col("cov") > low) & (F.col("cov") < high), 0.0).otherwise(full))).drop("_mn", "_ma")


def rejection(token_log_ratio: Column, mask: Column, window, level: str, upper: float, lower: float) -> Column:
    """Whether a token stays, judged by its own ratio, by its sequence's product of ratios, or by their geometric mean."""
    valid = F.when(mask, token_log_ratio)
    if level == "token":
        log = token_log_ratio
    elif level == "sequence":
        log = F.sum(valid).over(window)
    elif level == "geometric":
        log = F.avg(valid).over(window)
    else:
        raise ValueError(level)
    return mask & F.exp(clamp(log, -20.0, 20.0)).between(lower, upper)


def vetoed(token_log_ratio: Column, mask: Column, window, threshold: float) -> Column:
    """Whether any valid token of the sequence is so unlikely that all of it goes."""
    return F.coalesce(F.min(F.when(mask, token_log_ratio)).over(window) < F.log(F.lit(threshold)), F.lit(False))


def entropy(logits: Column) -> Column:
    """Of the distribution that logits stand for: logsumexp minus the mean logit."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.zip_with(logits, e, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) / total
    return top + F.log(total) - mean


def preference_loss(chosen: Column, rejected_: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0) -> Column:
    """Loss of a pair from its log-ratios: logistic (with smoothed labels) or squared."""
    d = chosen - rejected_
    soft = lambda x: F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # noqa: E731  -log sigmoid(x)
    if kind == "sigmoid":
        return (1 - smoothing) * soft(beta * d) + smoothing * soft(-beta * d)
    if kind == "ipo":
        return F.pow(d - 1 / (2 * beta), F.lit(2))
    raise ValueError(kind)


def adaptive_coefficient(kls: Column, start: float, target: float, horizon: float, n: Column) -> Column:
    """A penalty's coefficient after steps whose divergences are `kls` (in order): each moves it by the clipped relative error."""
    step = lambda b, k: b * (1 + clamp(k / target - 1, -0.2, 0.2) * n / horizon)
    return F.aggregate(kls, F.lit(start), step)
