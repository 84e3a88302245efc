"""Divergences of two distributions, each given by its k largest logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, EPS = -1e9, 1e-12


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    def scaled(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))

    return let(F.array_max(logits), lambda m: let(F.transform(logits, lambda x: F.exp(x - m)), scaled))


def over_union(ids: Column, logits: Column, union: Column) -> Column:
    """Probabilities over a union of ids; an id without a logit has next to none."""

    def logit(i: Column) -> Column:
        at = F.array_position(ids, i)
        return F.when(at > 0, F.get(logits, (at - 1).cast("int"))).otherwise(F.lit(MISSING))

    return softmax(F.transform(union, logit))


def kl(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * (F.log(a + EPS) - F.log(b + EPS))), F.lit(0.0), lambda s, x: s + x)


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats, 0 to ln 2."""
    return let(F.zip_with(p, q, lambda a, b: (a + b) / 2), lambda m: (kl(p, m) + kl(q, m)) / 2)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def position_bucket(t: Column, n: Column) -> Column:
    return F.when(t == 1, "1").when(t <= 4, "2-4").when(t <= 16, "5-16").when(t <= 63, "17-63").when(t > 0.95 * n, "last 5%").otherwise("interior")
