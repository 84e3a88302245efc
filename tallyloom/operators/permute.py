"""Orders of rows without sorting: a keyed bijection gives each row its place.

Places 0 to n - 1 are written as two digits, which are shifted round by round by what a
mixing function makes of the other one; results outside the range are sent through
again until they fall inside, as every cycle of a bijection comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, MOST_WALKS = 4, 64
PRIME = (1 << 31) - 1


def mixed(v: Column, key: Column, r: int) -> Column:
    t = (v * 1_597_334_677 + key + r * 374_761_393) % PRIME
    t = t.bitwiseXOR(F.shiftright(t, 13))
    return (t * 48_271 + F.lit(r)) % PRIME


def digits(n: int) -> tuple[int, int]:
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, -(-n // a)


def place(i: Column, n: int, key: Column) -> Column:
    """The place of row i among n, under a key: for each key all places occur once. n is below 2 ** 60; i outside 0 to n - 1 is null.

    A walk outside the range ends after fewer steps than the square root of n, and after one in nearly all cases; a row
    that is still outside after 64, which for n above 4096 has a chance below 2 ** -380, is an error.
    """
    if not 0 < n < 1 << 60:
        raise ValueError("n must be from 1 to 2 ** 60 - 1")
    a, b = digits(n)
    key = F.pmod(key.cast("long"), F.lit(PRIME))

    def once(x: Column) -> Column:
        state = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), F.pmod(x, F.lit(b)).alias("r"))
        step = lambda s, k: F.struct(F.pmod(s["l"] + mixed(s["r"], key + 2 * k, 1), F.lit(a)).alias("l"), s["r"].alias("r"))
        other = lambda s, k: F.struct(s["l"].alias("l"), F.pmod(s["r"] + mixed(s["l"], key + 2 * k + 1, 2), F.lit(b)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, lambda s, k: F.transform(F.array(step(s, k)), lambda t: other(t, k))[0], lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_WALKS)), once(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(i.between(0, n - 1), F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long")))[0])


def epochs(df: DataFrame, ordinal: str, total: int, mini: int, times: int, seed: int, *, shuffle: bool = True) -> DataFrame:
    """Rows once for each of several epochs with epoch, place and batch: in an order of its own, or as they are.

    ordinal counts rows from 0; their number must be a multiple of the batch size. No row meets another one: nothing is sorted
    or shuffled, and an epoch takes as many tasks as the rows do.
    """
    if mini < 1 or total % mini:
        raise ValueError(f"{total} rows are no multiple of {mini}")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    if total == 0:
        return out.withColumn("place", F.col(ordinal).cast("long")).withColumn("batch", F.col("place"))
    spot = place(F.col(ordinal), total, F.col("epoch") * 7_919 + F.lit(seed)) if shuffle else F.col(ordinal).cast("long")
    return out.withColumn("place", spot).withColumn("batch", F.floor(F.col("place") / mini).cast("long"))
