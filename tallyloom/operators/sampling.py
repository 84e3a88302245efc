"""Deterministic samples, selections and their allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*columns: str, seed: int = 0) -> Column:
    """An order that looks random but is the same at each run and for any layout: hexadecimal md5 of the key and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def take(df: DataFrame, n: int, keys: list[str], *, seed: int = 0) -> DataFrame:
    """n rows in hash order: each task keeps its first n, so nothing is shuffled but these."""
    return df.withColumn("_h", hash_order(*keys, seed=seed)).orderBy("_h", *keys).limit(n).drop("_h")


def per_group(df: DataFrame, group: list[str], order: list, n: int | Column) -> DataFrame:
    """The first n rows of each group; Spark keeps n a group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def allocate(counts: DataFrame, stratum: str, n: int, size: int) -> DataFrame:
    """Add quota: shares of `size` by largest remainder, ties to the name that sorts last, at most what there is.

    counts has one row a stratum, so the window over all of them is small.
    """
    w = Window.partitionBy()
    exact = F.col("n") * float(size) / F.sum("n").over(w)
    rows = counts.withColumns({"_e": exact, "_f": F.floor(exact)})
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), F.desc(stratum)))
    rows = rows.withColumns({"_r": rank, "_left": F.lit(size) - F.sum("_f").over(w)})
    return rows.withColumn("quota", F.least(F.col("_f") + (F.col("_r") <= F.col("_left")).cast("long"), F.col("n"))).select(stratum, "n", "quota")


def stratified(df: DataFrame, stratum: str, size: int, keys: list[str], *, seed: int = 0) -> DataFrame:
    """A proportional sample without replacement, in hash order within strata."""
    quotas = allocate(df.groupBy(stratum).agg(F.count("*").alias("n")), stratum, 0, size).select(stratum, "quota")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(*keys, seed=seed), *keys)))
    return ranked.join(F.broadcast(quotas), stratum).where("_r <= quota").drop("_r", "quota")


def fixed_strata(df: DataFrame, stratum: str, wanted: dict, keys: list[str], *, seed: int = 0) -> DataFrame:
    """So many rows of each stratum; a stratum with fewer is an error."""
    quota = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)])
    w = Window.partitionBy(stratum)
    ranked = df.where(F.col(stratum).isin(*wanted)).withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(hash_order(*keys, seed=seed), *keys)), "_q": quota[F.col(stratum)]})
    enough = F.when(F.col("_n") >= F.col("_q"), F.col("_r") <= F.col("_q")).otherwise(F.raise_error(F.lit("a stratum is too small")).cast("boolean"))
    return ranked.where(enough).drop("_n", "_r", "_q")


def backfill(primary: DataFrame, backup: DataFrame, key: str, n: int) -> DataFrame:
    """Primary rows, then backup rows of other keys, the first n by key."""
    return primary.unionByName(backup.join(primary.select(key).distinct(), key, "left_anti")).orderBy(key).limit(n)


def shard(keys: list[str], n: int) -> Column:
    """A shard number from the md5 of a key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long"), F.lit(n))


def resample(df: DataFrame, weight: Column, keys: list[str], *, seed: int = 0) -> DataFrame:
    """As many draws with replacement as there are rows, in proportion to weight + 1e-8, as a count a row.

    Systematic: draw i falls on the row whose stretch of the running total holds (i + u) of n; the
    running total is summed by blocks of rows first, so no task orders all of them.
    """
    salted = df.withColumns({"_w": weight + 1e-8, "_b": F.pmod(F.xxhash64(*keys), F.lit(256))})
    blocks = salted.groupBy("_b").agg(F.sum("_w").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy()
    starts = blocks.select("_b", (F.sum("s").over(w.orderBy("_b")) - F.col("s")).alias("_start"), F.sum("s").over(w).alias("_total"), F.sum("c").over(w).alias("_n"))
    placed = salted.join(F.broadcast(starts), "_b").withColumn("_end", F.col("_start") + F.sum("_w").over(Window.partitionBy("_b").orderBy(*keys)))
    u = (seed * 0.6180339887498949) % 1
    at = lambda x: F.ceil(F.least(F.lit(1.0), x / F.col("_total")) * F.col("_n") - u)
    return placed.withColumn("draws", (at(F.col("_end")) - at(F.col("_end") - F.col("_w"))).cast("long")).drop("_w", "_b", "_start", "_total", "_n", "_end")


def place_of(df: DataFrame, key: str, k: int, *, bins: int = 4096) -> tuple[int | None, int, int]:
    """The k-th smallest of a whole-number key (from 1, nulls last), which of the rows equal to it that is, and how many there are.

    Counts by bin are narrowed down to a single value, by at most `bins` lines a pass, so no task sees the whole order.
    """
    low, high, known, rows = df.agg(F.min(key), F.max(key), F.count(key), F.count("*")).first()
    if k > known:
        return None, k - known, rows - known
    while True:
        width = (high - low) // bins + 1
        counts = df.where(F.col(key).between(low, high)).groupBy(F.expr(f"(`{key}` - {low}L) div {width}L").alias("b")).count().collect()
        for b, n in sorted(map(tuple, counts)):
            if k <= n:
                break
            k -= n
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
        if low == high:
            return low, k, n


def head_tail(df: DataFrame, key: str, part: int, of: int, head: str, tail: str, out: str) -> DataFrame:
    """Add out: head for the first part/of rows in the order of a whole-number key, rounded down, else tail; nulls come last. Of rows equal to the last of them as many as there is room for, whichever."""
    k = df.count() * part // of
    if not k:
        return df.withColumn(out, F.lit(tail))
    cut, room, equal = place_of(df, key, k)
    same = F.col(key).eqNullSafe(F.lit(cut))
    before = F.col(key).isNotNull() if cut is None else F.coalesce(F.col(key) < cut, F.lit(False))
    if room == equal:
        return df.withColumn(out, F.when(before | same, head).otherwise(tail))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))) <= room
    return df.where(~same).withColumn(out, F.when(before, head).otherwise(tail)).unionByName(df.where(same).withColumn(out, F.when(first, head).otherwise(tail)))
