"""Draws with replacement: bootstrap of any aggregate, and the exact law of the majority of n draws."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a caller of majority_of_draws() says nothing, more draws than this are null; the law itself has no limit.
MOST_DRAWS = 64
#: Points of the unit circle that are held at a time, and the part of a chance below which doubles can't hold it.
POINTS, NOTHING = 4096, 1e-22


def hashed(*parts: Column) -> Column:
    """48 bits that follow from the parts' texts alone, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def indexed(df: DataFrame, keys: list[str], order: list[str], name: str = "index") -> tuple[DataFrame, DataFrame]:
    """Rows of each group numbered from 0 by a hash of the order and then the order itself, and the groups' sizes.

    Numbers are dealt within 256 parts of a group, and shifted by the sizes of the parts before: one group takes many
    tasks. The order columns tell rows of a group apart, and none is null.
    """
    salted = df.withColumn("_salt", F.substring(F.md5(F.concat_ws(":", *order)), 1, 2))
    ranked = salted.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_salt")
    shifts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_salt").alias("_s"), (F.sum("_c").over(w) - F.col("_c")).alias("_before"))
    on = reduce(lambda x, y: x & y, [ranked[k].eqNullSafe(shifts[f"_{k}"]) for k in keys], ranked["_salt"] == shifts["_s"])
    out = ranked.join(shifts, on).withColumn(name, F.col("_before") + F.col("_i"))
    return out.select(*df.columns, name), counts.groupBy(*keys).agg(F.sum("_c").alias("n"))


def draws(df: DataFrame, keys: list[str], order: list[str], size: int, *, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """`size` rows of each group drawn with replacement, `replicates` times over: adds replicate and draw, from 1.

    Which row a draw takes follows from the seed, the keys, replicate and draw, and the rows' order: not from
    partitions or runs. Each group gives replicates x size rows, however large it is.
    """
    if size < 1 or replicates < 1:
        raise ValueError("size and replicates must be positive")
    rows, sizes = indexed(df, keys, order, "_index")
    each = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(size))))
    spot = F.pmod(hashed(F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("replicate").cast("string"), F.col("draw").cast("string")), F.col("n"))
    each = each.select(*[F.col(k).alias(f"_{k}") for k in keys], "replicate", "draw", spot.alias("_spot"))
    on = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(each[f"_{k}"]) for k in keys], rows["_index"] == each["_spot"])
    return rows.join(each, on).select(*df.columns, "replicate", "draw")


def bootstrap(df: DataFrame, keys: list[str], order: list[str], size: int, reducers: dict[str, Column], *, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population deviation, over replicates, of any aggregates of `size` draws.

    A reducer is an aggregate column, native or a grouped pandas function; it may use `draw` for the order of draws.
    Groups without rows don't appear.
    """
    each = draws(df, keys, order, size, replicates=replicates, seed=seed).groupBy(*keys, "replicate").agg(*[c.alias(n) for n, c in reducers.items()])
    return each.groupBy(*keys).agg(*[x for n in reducers for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))])


def win_chances(classes: list[tuple[int, int]], n: int) -> list[float]:
    """The chance of one answer of each class to be the majority of n draws; classes are (count, how many answers have it).

    Of answers drawn equally often each is as likely to have been drawn first. Draws are taken as independent Poisson
    counts that add up to n, so no term is out of a double's range, whatever n. For each count that the winner may
    have, the others' generating functions are multiplied on the unit circle. Of t others with as many the winner
    has one part in t + 1, which is the integral of u to the t from 0 to 1: Gauss' rule gives that exactly.
    """
    total, answers, ks = sum(c * m for c, m in classes), sum(m for _, m in classes), np.arange(n + 1)
    logs = np.array([math.lgamma(k + 1.0) for k in ks])
    drawn = [np.exp(ks * math.log(n * c / total) - n * c / total - logs) for c, _ in classes]
    whole = math.exp(n * math.log(n) - n - logs[n])
    within = np.exp(sum(m * np.log(np.maximum(np.cumsum(d), 1e-300)) for d, (_, m) in zip(drawn, classes)))  # no answer is drawn more often
    points = 1 << (n + int(12 * math.sqrt(n)) + 31).bit_length()  # totals further off than these have no weight
    out, rules = np.zeros(len(classes)), {}
    for first in range(0, points // 2 + 1, POINTS):
        r = np.arange(first, min(first + POINTS, points // 2 + 1))
        weight = np.where((r == 0) | (r == points // 2), 1.0, 2.0) / points
        circle = lambda k: np.exp(2j * np.pi * (k * r % points) / points)
        below, before = [np.zeros(len(r), complex) for _ in classes], circle(0)
        for most in range(1, n + 1):
            below, before = [b + d[most - 1] * before for b, d in zip(below, drawn)], circle(most)
            if max(d[most] for d in drawn) * within[most] < NOTHING * whole:
                continue
            back, half = weight * circle(most - n), (min(n // most, answers) + 1) // 2
            if half not in rules:
                rules[half] = np.polynomial.legendre.leggauss(half)
            for x, w in zip(*rules[half]):
                each = [b + (x + 1) / 2 * d[most] * before for b, d in zip(below, drawn)]
                rest = [g ** (m - 1) for g, (_, m) in zip(each, classes)]
                left = [np.ones(len(r), complex)]
                for g, q in zip(each, rest):
                    left.append(left[-1] * g * q)
                right = back * (w / 2)
                for own in range(len(classes) - 1, -1, -1):
                    out[own] += drawn[own][most] * float(np.real(np.sum(left[own] * rest[own] * right)))
                    right = right * each[own] * rest[own]
    return [float(x / whole) for x in out]


@F.pandas_udf(T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("second", T.DoubleType())]))
def majority_moments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Mean and mean square of the majority's first value, from the classes of counts with their sums."""
    known: dict[tuple, list[float]] = {}
    for classes, draws_ in batches:
        out = []
        for own, n in zip(classes, draws_):
            if n is None or n != n:
                out.append((None, None))
                continue
            key = (tuple((c["c"], c["m"]) for c in own), int(n))
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = win_chances(list(key[0]), key[1])
            out.append(tuple(sum(w * c[s] / c["c"] for w, c in zip(known[key], own)) for s in ("total", "squares")))
        yield pd.DataFrame(out, columns=["mean", "second"])


def majority_of_draws(df: DataFrame, *, source: str, uid: str, vote: str, value: str, most: int | None = MOST_DRAWS) -> DataFrame:
    """Expected value and deviation of the majority of 2, 4, .. and N draws with replacement, per prompt, and their means by source.

    The majority's value is that of its first draw; of answers drawn equally often the first drawn counts. A null
    vote is an answer. Exact for any number of draws; if `most` is given, lines of more draws are null. Prompts of one
    row have no line. Answers are counted before rows meet, and those of equal counts taken together, so that what a prompt holds grows with
    the root of its rows.
    """
    answers = df.groupBy(source, uid, vote).agg(F.count("*").alias("c"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))
    alike = answers.groupBy(source, uid, "c").agg(F.count("*").alias("m"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    per = alike.groupBy(source, uid).agg(F.sum(F.col("c") * F.col("m")).alias("n"), F.sort_array(F.collect_list(F.struct("c", "m", "total", "squares"))).alias("classes")).where("n > 1")
    grid = F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.pow(F.lit(2), i).cast("long")), lambda x: x < F.col("n")), F.array(F.col("n"))))
    told = per.withColumn("k", F.explode(grid)).withColumn("m", majority_moments("classes", F.col("k") if most is None else F.when(F.col("k") <= most, F.col("k"))))
    deviation = F.sqrt(F.greatest(F.col("m.second") - F.col("m.mean") * F.col("m.mean"), F.lit(0.0)))
    return told.groupBy(source, "n", "k").agg(F.count("*").alias("n_prompts"), F.avg("m.mean").alias("maj"), F.avg(deviation).alias("maj_std"))
