"""Policy losses by name: each adds the loss of every token to rows of tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyloom.functions import losses as L
from tallyloom.sources import folders

from .bootstrap import hashed

LOSSES: dict[str, Callable[..., DataFrame]] = {}


@dataclass(frozen=True)
class Settings:
    """Columns of the tokens, and what the losses are set to."""

    new: str = "new"
    old: str = "old"
    advantage: str = "advantage"
    mask: str = "mask"
    sequence: str = "sequence"
    t: str = "t"
    low: float = 0.2
    high: float = 0.2
    dual: float = 3.0
    cov_ratio: float = 0.0002
    cov_low: float = 1.0
    cov_high: float = 5.0
    kl_coefficient: float = 1.0
    geometric_clip: float = 0.4
    seed: int = 0


def register(name: str):
    """Register a loss; a second one of the same name is an error unless it is the same."""

    def add(f):
        if LOSSES.get(name, f) is not f:
            raise ValueError(f"policy loss {name} is taken")
        LOSSES[name] = f
        return f

    return add


def policy_loss(name: str, tokens: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The tokens with `loss`, which is null where the mask is off. A name that isn't known is an error that names those that are."""
    if name not in LOSSES:
        raise ValueError(f"no policy loss {name}; there are {', '.join(sorted(LOSSES))}")
    s = settings or Settings()
    return LOSSES[name](tokens, s).withColumn("loss", F.when(F.col(s.mask), F.col("loss")))


def policy_losses(names: list[str], tokens: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The tokens with `loss_<name>` and, where the loss singles tokens out, `singled_<name>` for each of the names.

    The tokens are stored once; the losses are columns of the same rows, so windows over a sequence share one shuffle.
    """
    path = folders.fresh_path(tokens.sparkSession, "tokens")
    tokens.write.parquet(path)
    rows = tokens.sparkSession.read.schema(tokens.schema).parquet(path)
    for name in names:
        rows = policy_loss(name, rows, settings).withColumnsRenamed({"loss": f"loss_{name}", "singled": f"singled_{name}"})
    return rows


def parts(s: Settings) -> tuple[Column, Column, Column]:
    """Advantage, log-ratio, and the ratio as it is."""
    d = F.col(s.new) - F.col(s.old)
    return F.col(s.advantage), d, F.exp(d)


@register("vanilla")
def vanilla(df: DataFrame, s: Settings) -> DataFrame:
    return df.withColumn("loss", L.policy_loss(F.col(s.new), F.col(s.old), F.col(s.advantage), low=s.low, high=s.high, dual=s.dual))


@register("gspo")
def gspo(df: DataFrame, s: Settings) -> DataFrame:
    """The sequence's mean log-ratio, at most 10, is every token's."""
    w = Window.partitionBy(s.sequence)
    d = F.avg(F.when(F.col(s.mask), F.col(s.new) - F.col(s.old))).over(w)
    return df.withColumn("loss", L.clipped(F.exp(F.least(d, F.lit(10.0))), F.col(s.advantage), s.low, s.high))


@register("gpg")
def gpg(df: DataFrame, s: Settings) -> DataFrame:
    return df.withColumn("loss", -F.col(s.new) * F.col(s.advantage))


@register("geo_mean")
def geo_mean(df: DataFrame, s: Settings) -> DataFrame:
    return df.withColumn("loss", L.geometric_policy_loss(s.new, s.old, F.col(s.advantage), s.mask, Window.partitionBy(s.sequence), s.geometric_clip))


def covariances(df: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """The tokens with `_cov` (of valid ones: how log-probability and advantage lie from their means), and how many are valid.

    Rounded, so that which of equal ones go first doesn't hang on the order in which means were summed.
    """
    valid = F.col(s.mask)
    m = df.agg(F.avg(F.when(valid, F.col(s.new))).alias("n"), F.avg(F.when(valid, F.col(s.advantage))).alias("a"), F.count_if(valid).alias("c")).first()
    cov = (F.col(s.new) - F.lit(m.n)) * (F.col(s.advantage) - F.lit(m.a))
    return df.withColumn("_cov", F.when(valid, F.round(cov, 9))), m.c


def first_of(df: DataFrame, order: list[Column], n: int, keys: list[str]) -> DataFrame:
    """The keys of the first n rows in an order that tells rows apart: dealt and sorted by ranges, counted by range, so no task holds more than its range."""
    spark = df.sparkSession
    path = folders.fresh_path(spark, "first")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).select(*keys, "_at").write.parquet(path)
    held = spark.read.parquet(path)
    counts = sorted((r.p, r.c) for r in held.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("c")).collect())  # one row a range
    ends, left = [], n
    for p, c in counts:
        if left > 0:
            ends.append((p << 33, (p << 33) + min(c, left)))
            left -= c
    inside = F.lit(False)
    if ends:
        inside = F.col("_at") < ends[-1][1]
    return held.where(inside).select(*keys)


def last_of_first(df: DataFrame, order: dict[str, bool], n: int) -> Row | None:
    """The n-th row in an order that tells rows apart (names of columns, and whether they descend), or the last if there are fewer; None without rows.

    Dealt and sorted by ranges and counted by range, so no task holds more than its range and the driver sees one row.
    """
    spark, path = df.sparkSession, folders.fresh_path(df.sparkSession, "first")
    by = [F.desc(c) if down else F.asc(c) for c, down in order.items()]
    df.select(*order).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path)
    counts = sorted((r.p, r.c) for r in held.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("c")).collect())  # one row a range
    at = None
    for p, c in counts:
        if n > 0:
            at = (p << 33) + min(c, n) - 1
            n -= c
    return None if at is None else held.where(F.col("_at") == at).first()


def up_to(order: dict[str, bool], last: Row | None) -> Column:
    """Whether a row is no later in the order than `last`, nulls where Spark sorts them: first if ascending, last if descending."""
    out = F.lit(last is not None)
    for name, down in reversed(list(order.items()) if last is not None else []):
        c, end = F.col(name), F.lit(last[name])
        before = F.when(end.isNull(), c.isNotNull() & F.lit(down)).when(c.isNull(), F.lit(not down)).otherwise((c > end) if down else (c < end))
        out = before | (c.eqNullSafe(end) & out)
    return out


def able_of(s: Settings, cut: Column, plain: Column) -> Column:
    return F.col(s.mask) & (F.col("_cov") > s.cov_low) & (F.col("_cov") < s.cov_high) & ~(cut > plain)


@register("clip_cov")
def clip_cov(df: DataFrame, s: Settings) -> DataFrame:
    """As a clipped loss, but tokens (`singled`) drawn by a hash from those whose covariance is between the bounds, and that the clip didn't touch, teach nothing.

    A share of cov_ratio of the valid tokens is drawn, one at least.
    """
    a, _, ratio = parts(s)
    plain, cut = -a * ratio, -a * L.clamp(ratio, 1 - s.low, 1 + s.high)
    told, n = covariances(df, s)
    able = told.where(able_of(s, cut, plain))
    draw = hashed(F.lit(str(s.seed)), *[F.col(k).cast("string") for k in (s.sequence, s.t)])
    order = {"_h": False, s.sequence: False, s.t: False}
    last = last_of_first(able.withColumn("_h", draw), order, max(int(s.cov_ratio * n), 1))
    chosen = able_of(s, cut, plain) & up_to(order, last)
    told = told.withColumn("_h", draw).withColumn("singled", F.coalesce(chosen, F.lit(False)))
    return told.withColumn("loss", F.when(F.col("singled"), 0.0).otherwise(F.greatest(plain, cut))).drop("_cov", "_h")


@register("kl_cov")
def kl_cov(df: DataFrame, s: Settings) -> DataFrame:
    """Without a clip; the tokens (`singled`) of the greatest covariances, a share of cov_ratio of the valid ones and one at least, pay for their distance."""
    a, d, ratio = parts(s)
    told, n = covariances(df, s)
    order = {"_cov": True, s.sequence: False, s.t: False}
    last = last_of_first(told.where(F.col(s.mask)), order, max(1, int(n * s.cov_ratio)))
    told = told.withColumn("singled", F.coalesce(F.col(s.mask) & up_to(order, last), F.lit(False)))
    return told.withColumn("loss", -a * ratio + F.when(F.col("singled"), s.kl_coefficient * F.abs(d)).otherwise(0.0)).drop("_cov")
