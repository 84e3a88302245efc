"""Joins and set operations of rollout analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, build: DataFrame, key: str, order: list, *, how: str = "left") -> DataFrame:
    """Join to the last row of each key by `order`: the build side is made unique first."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    unique = build.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return df.join(unique, key, how)


def anchored(runs: DataFrame, anchor: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each run row beside the first anchor row of its key; keys without an anchor drop out."""
    first = anchor.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_a")).select(key, *[F.col(f"_a.{c}").alias(f"anchor_{c}") for c in columns])
    return runs.join(first, key)


def coverage(have: DataFrame, need: DataFrame, key: str) -> DataFrame:
    """One row a key on either side: missing, extra or shared."""
    h, n = have.select(key).distinct().withColumn("_h", F.lit(1)), need.select(key).distinct().withColumn("_n", F.lit(1))
    return h.join(n, key, "full").select(key, F.when(F.col("_h").isNull(), "missing").when(F.col("_n").isNull(), "extra").otherwise("shared").alias("status"))


def override(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have a key the update's values win."""
    values = [c for c in base.columns if c != key]
    return base.alias("b").join(update.alias("u"), key, "full").select(key, *[F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}")).alias(c) for c in values])


def zip_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of two batches of equal rows; shared columns must agree, else an error."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    j = a.alias("a").join(b.alias("b"), key, "full")
    agree = F.lit(True)
    for c in shared:
        agree = agree & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = j.withColumn("_ok", F.when(agree, True).otherwise(F.raise_error(F.lit("shared columns differ")).cast("boolean"))).where("_ok")
    return j.select(key, *[F.col(f"a.{c}").alias(c) for c in a.columns if c != key], *[F.col(f"b.{c}").alias(c) for c in b.columns if c != key and c not in shared])


def against_baseline(df: DataFrame, name: str, baseline: str, values: list[str], keys: list[str]) -> DataFrame:
    """Add a delta of each value to the baseline's row of the same keys."""
    base = df.where(F.col(name) == baseline).select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return df.join(base, keys, "left").select(*df.columns, *[(F.col(v) - F.col(f"_{v}")).alias(f"{v}_delta") for v in values])


def pair_order(df: DataFrame, group: str, order: str, acc: str, score: str) -> DataFrame:
    """Per group how often pairs of samples are ordered alike by acc and score, weighted by the difference in acc; half without any.

    Closed form by pairs within a group, which is one prompt's samples.
    """
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")) & (F.col(f"a.{acc}") != F.col(f"b.{acc}")))
    d, s = F.col(f"a.{acc}") - F.col(f"b.{acc}"), F.col(f"a.{score}") - F.col(f"b.{score}")
    own = pairs.groupBy(F.col(f"a.{group}").alias(group)).agg((F.sum(F.abs(d) * (F.sign(d) == F.sign(s)).cast("double")) / F.sum(F.abs(d))).alias("agreement"))
    return df.select(group).distinct().join(own, group, "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.5)))


def competitors(group: str, acc: str, value: str) -> tuple[Column, Column]:
    """Mean value of group members with a lower and with a higher acc (told apart to a millionth): ranges of a window instead of a self join."""
    w = Window.partitionBy(group).orderBy(F.round(F.col(acc).cast("double") * 1_000_000).cast("long"))
    return F.avg(value).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.avg(value).over(w.rangeBetween(1, Window.unboundedFollowing))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def whole_key(key: Column) -> Column:
    """A key written as a whole number, with blanks around it, as a number; else null."""
    t = F.trim(key.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+\z"), t.try_cast("long"))


def parsed_lookup(df: DataFrame, key: str, build: DataFrame, build_key: str) -> DataFrame:
    """Rows with what the build side has for their key as a whole number; keys that aren't one, or have nothing, drop out."""
    numbered = df.withColumn("_key", whole_key(F.col(key)))
    return numbered.join(build.withColumnRenamed(build_key, "_build"), F.col("_key") == F.col("_build")).drop("_key", "_build")


def by_text(df: DataFrame, text: Column, subset: DataFrame, subset_text: Column, ids: str) -> DataFrame:
    """Rows whose stripped text is in a subset, with the subset's id of it; the least id where a text stands there more than once.

    Texts are compared by their digests, so only these are shuffled for the subset.
    """
    own = subset.select(F.sha2(F.trim(subset_text), 256).alias("_digest"), F.col(ids)).groupBy("_digest").agg(F.min(ids).alias(ids))
    return df.withColumn("_mine", F.sha2(F.trim(text), 256)).join(own, F.col("_mine") == F.col("_digest")).drop("_mine", "_digest")


def share_of_length(t: str, *keys: str) -> tuple[Column, Column]:
    """How far a group goes, and how far along it a row is: one window, no join back."""
    n = F.max(t).over(Window.partitionBy(*keys))
    return n, F.col(t) / n


def prefixed_lookup(df: DataFrame, key: str, build: DataFrame, build_key: str, value: str, prefix: str) -> DataFrame:
    """Add `value` by the key as it is, else by the key without a prefix; null without either. The build side has each key once."""
    names = build.select(F.col(build_key).alias("_b"), F.col(value).alias("_v"))
    bare = F.regexp_replace(F.col(key), f"^{prefix}", "")
    once = df.join(names, F.col(key) == F.col("_b"), "left").withColumnRenamed("_v", "_exact").drop("_b")
    both = once.join(names, (bare == F.col("_b")) & F.col("_exact").isNull(), "left").drop("_b")
    return both.withColumn(value, F.coalesce("_exact", "_v")).drop("_exact", "_v")


def cached_labels(df: DataFrame, cache: DataFrame, keys: list[str], *, missing: str = "MISSING") -> DataFrame:
    """Rows with the label and reason that a cache holds for their keys, or that they are missing there."""
    return df.join(cache, keys, "left").withColumns({"label": F.coalesce("label", F.lit(missing)), "reason": F.coalesce("reason", F.lit(""))})


def attached(keys: DataFrame, sides: list[DataFrame], on: list[str]) -> DataFrame:
    """Keys beside what every side has for them; a key that one side lacks drops out."""
    out = keys
    for side in sides:
        out = out.join(side, on)
    return out
