"""Batch algebra: rows with an ordinal, cut, repeated, padded, reordered and balanced."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slice_rows(df: DataFrame, ordinal: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    o = F.col(ordinal)
    keep = (o >= start) & ((o - start) % step == 0)
    return df.where(keep & (o < stop) if stop is not None else keep)


def chunk(ordinal: Column, total: Column, n: int) -> Column:
    """Number of the chunk, of n equal ones (the first larger by one if they can't be)."""
    size, rest = F.floor(total / n), total % n
    return F.when(ordinal < rest * (size + 1), F.floor(ordinal / (size + 1))).otherwise(rest + F.floor((ordinal - rest * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long")


def repeat(df: DataFrame, ordinal: str, times: int, *, interleave: bool = True) -> DataFrame:
    """Each row `times` times with a new ordinal: copies side by side, or whole batches one after the other."""
    out = df.withColumn("_n", F.lit(0)) if interleave else df.join(F.broadcast(df.agg(F.count("*").alias("_n"))), how="cross")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    new = F.col(ordinal) * times + F.col("copy") if interleave else F.col("copy") * F.col("_n") + F.col(ordinal)
    return out.withColumn(ordinal, new).drop("_n")


def repeat_by(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its own column says; not at all for 0."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))


def pad_to_multiple(df: DataFrame, ordinal: str, divisor: int, total: int) -> DataFrame:
    """Rows from the head again, cyclically, until the count is a multiple; `padding` marks them."""
    missing = -total % divisor
    more = df.where(F.col(ordinal) < missing).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.lit(missing - 1) - F.col(ordinal)) / max(total, 1)).cast("int"))))
    more = more.withColumn(ordinal, F.lit(total) + F.col("_k") * total + F.col(ordinal)).drop("_k")
    return df.withColumn("padding", F.lit(False)).unionByName(more.withColumn("padding", F.lit(True))) if missing else df.withColumn("padding", F.lit(False))


def unfold(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Array columns cut into n equal pieces, one row each; other columns are repeated."""
    parts = [_cut(c, n) for c in columns]
    zipped = F.arrays_zip(*[p.alias(c) for p, c in zip(parts, columns, strict=True)])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.posexplode(zipped).alias("piece", "_z")).select(*kept, "piece", *[F.col(f"_z.{c}").alias(c) for c in columns])


def _cut(c: str, n: int) -> Column:
    size = F.floor(F.size(c) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(c), i * size + 1, size))


def response_mask(ids: Column, ends: list[int]) -> Column:
    """1 up to and with the first end id, 0 after it."""
    place = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(x.isin(*ends), i)), lambda i: i.isNotNull()))
    return F.transform(ids, lambda x, i: (place.isNull() | (i <= place)).cast("int"))


def pad_vector(v: Column, size: int, fill, *, left: bool = False) -> Column:
    """An array of exactly `size` values: cut at the end, filled at the end or the start."""
    cut = F.slice(v, 1, size)
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(v), F.lit(0)))
    return F.concat(more, cut) if left else F.concat(cut, more)


def workload(length: int) -> int:
    """What a sequence costs: in proportion to its length and to the square of it."""
    return 24_576 * length + length * length


def largest_differencing(lengths: list[int], k: int, *, equal_size: bool = False) -> list[list[int]]:
    """Indices in k parts of nearly equal sums, the largest sum first: the two states that differ most are merged again and again.

    A state is k sets in falling order of (sum, how many, their items); merging puts the largest set of the one to the
    smallest of the other. Of states that differ alike the one with the larger first set goes first. With equal_size
    states start as k neighbours in the order of lengths, so that all parts get as many items. Fewer items than parts,
    or items that can't be dealt evenly, are an error.
    """
    if not 0 < k <= len(lengths):
        raise ValueError(f"{len(lengths)} items for {k} parts")
    if equal_size and len(lengths) % k:
        raise ValueError("items can't be dealt evenly")

    def state(sets: list[tuple]) -> tuple:
        sets = sorted(sets, reverse=True)
        total, count, items = sets[0]
        return sets[-1][0] - total, -total, -count, [(-i, -n) for i, n in items], sets

    order = sorted((n, i) for i, n in enumerate(lengths))
    first = [order[j : j + k] for j in range(0, len(order), k)] if equal_size else [[x] for x in order]
    heap = [state([(n, 1, ((i, n),)) for n, i in own] + [(0, 0, ())] * (k - len(own))) for own in first]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
        heapq.heappush(heap, state([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b), strict=True)]))
    return [sorted(i for i, _ in items) for _, _, items in heap[0][-1]]


def balance(df: DataFrame, group: str, length: str, key: str, k: int) -> DataFrame:
    """Add `part`: within each group (a batch, which fits one task) rows in k parts of nearly equal length, or as many as it has rows."""
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.LongType())])

    def run(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        rows = batches.sort_values(key, ignore_index=True)
        part = [0] * len(rows)
        for p, own in enumerate(largest_differencing(rows[length].tolist(), min(k, len(rows)))):
            for i in own:
                part[i] = p
        return rows.assign(part=part)

    return df.groupBy(group).applyInPandas(run, schema)


def token_budget_parts(df: DataFrame, group: str, length: str, budget: int) -> DataFrame:
    """How many micro-batches each group needs: its tokens over the budget, at most one a row."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(length).alias("tokens")).withColumn("parts", F.least(F.col("n"), F.ceil(F.col("tokens") / budget)))


def pop(df: DataFrame, columns: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Some columns split off (with the key), and the rest without them."""
    return df.select(*key, *columns), df.drop(*[c for c in columns if c not in key])


def reorder(df: DataFrame, ordinal: str, permutation: DataFrame) -> DataFrame:
    """Rows under new ordinals: permutation has place (new) and source (old), one row each."""
    p = permutation.select(F.col("source").alias(ordinal), F.col("place").alias("_place"))
    return df.join(p, ordinal).withColumn(ordinal, F.col("_place")).drop("_place")


def inverse(permutation: DataFrame) -> DataFrame:
    """place and source swapped; a permutation that hits a place twice or misses one is an error."""
    n = permutation.agg(F.count("*").alias("n"), F.count_distinct("place").alias("p"), F.count_distinct("source").alias("s"), F.max("place").alias("mp"), F.max("source").alias("ms")).first()
    if n.n and not (n.n == n.p == n.s == n.mp + 1 == n.ms + 1):
        raise ValueError("not a permutation")
    return permutation.select(F.col("source").alias("place"), F.col("place").alias("source"))


def least_loaded(lengths: list[int], k: int, *, equal_size: bool = False) -> list[list[int]]:
    """Items as they come to the part with the least sum, the first of equals; with equal_size parts that hold fewer items go first."""
    more = sum(lengths) + 1 if equal_size else 0
    parts, heap = [[] for _ in range(k)], [(0, p) for p in range(k)]
    for i, n in enumerate(lengths):
        held, p = heap[0]
        parts[p].append(i)
        heapq.heapreplace(heap, (held + n + more, p))
    if equal_size and any(len(p) * k != len(lengths) for p in parts):
        raise ValueError("items can't be dealt evenly")
    return parts


def budget_batches(lengths: list[int], budget: int, *, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """As many micro-batches as the tokens need at `budget` each, balanced by workload; the large ones stand in the middle.

    At least `least`, and a multiple of `multiple`, but never more than there are items, which is an error. A batch may
    pass the budget a little: it is what their number comes from. A single item over the budget is an error.
    """
    if not lengths:
        return []
    if max(lengths) > budget:
        raise ValueError(f"an item of {max(lengths)} is over the budget of {budget}")
    k = max(least, min(len(lengths), -(-sum(lengths) // budget)))
    k = -(-k // multiple) * multiple
    cost = [workload(n) for n in lengths]
    parts = sorted(largest_differencing(cost, k), key=lambda p: (sum(cost[i] for i in p), p[0]), reverse=True)
    return parts[::2][::-1] + parts[1::2]


def rank_order(lengths: list[int], ranks: int, *, mini: int | None = None) -> list[int]:
    """The order of a batch's rows by which an even deal gives each rank about the same workload.

    With `mini` each mini-batch of that size is balanced by itself; rows past the last whole one are left out. Within a
    rank small items stand at both ends.
    """
    cost = [workload(n) for n in lengths]
    if mini is None:
        parts = largest_differencing(cost, ranks, equal_size=True)
    else:
        parts = [[] for _ in range(ranks)]
        for start in range(0, len(cost) // mini * mini, mini):
            for own, p in zip(parts, largest_differencing(cost[start : start + mini], ranks, equal_size=True), strict=True):
                own += [start + i for i in p]
    out = []
    for p in parts:
        p = sorted(p, key=lambda i: (cost[i], i))
        out += p[::2] + p[1::2][::-1]
    return out


def placed(df: DataFrame, group: str, length: str, key: str, order, name: str = "place") -> DataFrame:
    """Add the place of each row in order(lengths) within each group (a batch, which fits one task); rows that it leaves out have null."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        place: list = [None] * len(rows)
        for k, i in enumerate(order(rows[length].tolist())):
            place[i] = k
        return rows.assign(**{name: pd.array(place, dtype="Int64")})

    return df.groupBy(group).applyInPandas(run, schema)


def partitioned(df: DataFrame, group: str, length: str, key: str, cut, name: str = "part") -> DataFrame:
    """Add the part of each row, cut(lengths) within each group (a batch, which fits one task)."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True)
        part = [0] * len(rows)
        for p, own in enumerate(cut(rows[length].tolist())):
            for i in own:
                part[i] = p
        return rows.assign(**{name: part})

    return df.groupBy(group).applyInPandas(run, schema)


def fold(df: DataFrame, ordinal: str, groups: int, total: int, columns: list[str]) -> DataFrame:
    """(B) to (groups, B / groups): one row a group with its columns as arrays in order."""
    if total % groups:
        raise ValueError(f"{total} rows can't be folded into {groups}")
    g = F.floor(F.col(ordinal) / (total // groups)).alias("group")
    rows = df.groupBy(g).agg(F.array_sort(F.collect_list(F.struct(ordinal, *columns))).alias("_x"))
    return rows.select("group", *[F.col(f"_x.{c}").alias(c) for c in columns])


def loss_mask(prompt: Column, response: Column, size: Column) -> Column:
    """1 for tokens that teach: those of the response but its last, shifted to the token before (the last prompt token predicts the first one)."""
    return F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: ((i >= prompt - 1) & (i < prompt + response - 1)).cast("int"))


def fitted(v: Column, size: int, fill, how: str) -> Column:
    """An array of exactly `size` values, filled at the end; a longer one is cut left, right or in the middle, or is an error."""
    n = F.size(v)
    half = size // 2
    cut = {
        "left": F.slice(v, n - size + 1, F.lit(size)), "right": F.slice(v, 1, size), "middle": F.concat(F.slice(v, 1, half), F.slice(v, n - (size - half) + 1, F.lit(size - half))),
        "error": F.raise_error(F.format_string(f"%d values where {size} may be", n)).cast("array<bigint>"),
    }[how]
    return F.when(n > size, cut).otherwise(F.concat(v, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - n, F.lit(0)))))
