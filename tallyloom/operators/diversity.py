"""How alike the texts of a group are: BLEU of each against all others, without pairing them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = 4
#: Characters of text whose n-grams are sorted at a time, and how far a hash is cut to ask whether other stretches have it.
CHARACTERS, CUT = 8_000_000, np.uint64(28)


def international(text: Column) -> Column:
    """Tokens: marks part from what isn't a digit, symbols stand alone, white space separates."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\P{N})(\p{P})", "$1 $2 ")
    t = F.regexp_replace(F.regexp_replace(t, r"(\p{P})(\P{N})", " $1 $2"), r"(\p{S})", " $1 ")
    return F.array_remove(F.split(t, r"[\s\p{Z}]+"), "")


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length: byte by byte of all numbers, those that are mostly alike compressed."""
    out = [np.uint32(len(columns[0])).tobytes()]
    for c in columns:
        for plane in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T:
            raw = plane.tobytes()
            less = zlib.compress(raw, 1) if len(np.unique(plane[:256])) < 100 else raw
            out += [np.uint32(len(less)).tobytes(), less] if len(less) < len(raw) else [np.uint32(len(raw)).tobytes(), raw]
    return b"".join(out)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        planes = np.empty((np.dtype(kind).itemsize, n), np.uint8)
        for plane in planes:
            size = int(np.frombuffer(data, np.uint32, 1, at)[0])
            raw = data[at + 4 : at + 4 + size]
            plane[:] = np.frombuffer(raw if size == n else zlib.decompress(raw), np.uint8)
            at += 4 + size
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
    return out


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted columns another value begins."""
    return np.flatnonzero(reduce(np.logical_or, [np.concatenate(([True], c[1:] != c[:-1])) for c in columns])) if len(columns[0]) else np.zeros(0, int)


def sorted_by(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    clash = (h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])
    return np.lexsort((g, h)) if clash.any() else order


def tops(h: np.ndarray, g: np.ndarray, c: np.ndarray, next_: np.ndarray, holder: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lines sorted by hash, one an n-gram: its largest count, whose it is, and the largest count of any other row; of equal ones these two are the same."""
    at = runs(h, g)
    sizes = np.diff(np.append(at, len(h)))
    most = np.maximum.reduceat(c, at)
    own = c == np.repeat(most, sizes)
    alone = np.add.reduceat(own.astype(np.int64), at) == 1
    other = np.maximum.reduceat(np.where(own, next_, c), at)
    return h[at], g[at], most, np.where(alone, other, most), np.maximum.reduceat(np.where(own, holder, 0), at)


def counted(texts: list[tuple[int, np.ndarray, np.ndarray]], seeds: list[tuple[int, int]]) -> Iterator[tuple]:
    """n, and by n-gram of a stretch of texts, sorted by hash: what tops() gives. A holder is the text's place."""
    lengths = np.array([len(a) for _, a, _ in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    both = [np.concatenate([t[k] for t in texts]).astype(np.int64).view(np.uint64) for k in (1, 2)]
    starts = [np.array([s[k] for s in seeds], np.int64).view(np.uint64)[row] for k in (0, 1)]
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))  # tokens from here to the text's end
    for n in range(1, ORDERS + 1):
        at = np.flatnonzero(left >= n)
        if not len(at):
            continue
        h, g = (reduce(lambda v, k, x=x: mixed(v, x[at + k]), range(n), mixed(s[at], np.uint64(n))) for s, x in zip(starts, both))
        g = (g >> np.uint64(32)).astype(np.uint32)
        order = sorted_by(h, g)
        h, g, r = h[order], g[order], row[at][order]
        first = runs(h, g, r)  # rows stand in order within an n-gram
        c = np.diff(np.append(first, len(h))).astype(np.uint32)
        yield n, *tops(h[first], g[first], c, np.zeros(len(first), np.uint32), r[first])


def ranged(h: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of sorted hashes that occur, and from where to where."""
    part = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    edges = runs(part)
    return ((int(part[i]), i, j) for i, j in zip(edges, np.append(edges[1:], len(h))))


def held(texts: list[tuple[int, np.ndarray, np.ndarray]], seeds: list[tuple[int, int]], ranges: int, shared: dict | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(range of hashes, n, stretch, packed lines) of a stretch of texts. With what is shared, by n and range, only such n-grams; the rest is summed up where it is, in a range below 0."""
    stretch = texts[0][0]
    for n, h, g, c, second, holder in counted(texts, seeds):
        if shared is not None:
            cut = runs(h >> CUT)
            flags = np.concatenate([shared[n, part] for part, _, _ in ranged(h[cut], ranges)])
            own = ~np.repeat(flags, np.diff(np.append(cut, len(h))))
            yield -1 - stretch, n, stretch, packed(np.bincount(holder[own], weights=(c.astype(np.int64) - second)[own], minlength=1).astype(np.uint64))
            h, g, c, second, holder = (x[~own] for x in (h, g, c, second, holder))
        for part, i, j in ranged(h, ranges):
            yield part, n, stretch, packed(np.diff(h[i:j], prepend=np.uint64(0)), g[i:j], c[i:j], second[i:j], holder[i:j])


LINES = ("u8", "u4", "u4", "u4", "u4")


def stretched(t: pd.DataFrame) -> tuple[list, list]:
    t = t.sort_values("i")
    return [(int(p), np.asarray(a), np.asarray(b)) for p, a, b in zip(t["pid"], t["a"], t["b"])], list(zip(t["ga"], t["gb"]))


def asked(ranges: int):
    """Of a stretch, the hashes' first bits: all that is needed to tell which n-grams no other stretch has."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        texts, seeds = stretched(t)
        out = []
        for n, h, *_ in counted(texts, seeds):
            h = h[runs(h >> CUT)]
            out += [(part, n, texts[0][0], packed(np.diff(h[i:j] >> CUT, prepend=np.uint64(0)))) for part, i, j in ranged(h, ranges)]
        return pd.DataFrame(out, columns=["part", "n", "pid", "data"])

    return run


def told(lines: pd.DataFrame) -> pd.DataFrame:
    """By stretch a bit for each of its hashes: whether another stretch has it too."""
    found = [np.cumsum(unpacked(x, "u8")[0], dtype=np.uint64) for x in lines["data"]]
    _, back, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    flags = np.split(times[back] > 1, np.cumsum([len(f) for f in found])[:-1])
    return lines[["part", "n", "pid"]].assign(data=[np.uint32(len(f)).tobytes() + zlib.compress(np.packbits(f).tobytes(), 1) for f in flags])


def gathered(ranges: int):
    """Packed lines of a stretch's shared n-grams, and sums of the others."""

    def run(t: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame([], columns=["part", "n", "pid", "data"])
        bits = lambda x: np.unpackbits(np.frombuffer(zlib.decompress(x[4:]), np.uint8), count=int(np.frombuffer(x, np.uint32, 1)[0])).astype(bool)
        shared = {(int(n), int(part)): bits(x) for part, n, x in zip(marks["part"], marks["n"], marks["data"])}
        return pd.DataFrame(list(held(*stretched(t), ranges, shared)), columns=["part", "n", "pid", "data"])

    return run


def exceeded(lines: pd.DataFrame) -> pd.DataFrame:
    """By stretch, how far each text's counts of one range's n-grams of one length exceed those of all others."""
    if lines["part"].iloc[0] < 0:
        return lines[["pid", "n", "data"]]
    found = [unpacked(x, *LINES) for x in lines["data"]]
    of = np.concatenate([np.full(len(f[0]), i, np.uint64) for i, f in enumerate(found)])
    h, g, c, second, holder = (np.concatenate([np.cumsum(f[k], dtype=np.uint64) if k == 0 else f[k] for f in found]) for k in range(5))
    order = sorted_by(h, g)
    _, _, c, second, holder = tops(h[order], g[order], c[order], second[order], ((of << np.uint64(32)) | holder)[order])
    over = c.astype(np.int64) - second
    rows = []
    stretch, text = (holder >> np.uint64(32)).astype(np.int64), (holder & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for i, first in enumerate(lines["pid"]):
        at = (stretch == i) & (over > 0)
        if at.any():
            rows.append((first, lines["n"].iloc[0], packed(np.bincount(text[at], weights=over[at]).astype(np.uint64))))
    return pd.DataFrame(rows, columns=["pid", "n", "data"])


def summed(parts: pd.DataFrame) -> pd.DataFrame:
    """One line a text of a stretch: its sums by n."""
    found = [(n, unpacked(x, "u8")[0]) for n, x in zip(parts["n"], parts["data"])]
    out = np.zeros((max(len(x) for _, x in found), ORDERS), np.int64)
    for n, x in found:
        out[: len(x), n - 1] += x.astype(np.int64)
    return pd.DataFrame({"_pid": parts["pid"].iloc[0], "_i": np.arange(len(out)), **{f"_over{n}": out[:, n - 1] for n in range(1, ORDERS + 1)}})


def excess(tokens: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """By text and n, by how much counts of n-grams exceed the largest count of the same n-gram in any other text of the group.

    A count is clipped only where it alone is the group's largest, and then to the second largest. So each stretch of
    texts gives at most one line an n-gram, and an n-gram that every text has is no heavier than a rare one. Stretches
    first ask which n-grams others have, by 36 bits a hash in steps; chance agreement only sends a line in vain. Lines are
    sorted by hash and packed, about 12 bytes each: 64 bits of the n-gram's hash as steps and 32 of another one.
    """
    hashed = lambda *more: F.transform("tokens", lambda x: F.xxhash64(*more, x))
    seed = lambda *more: F.xxhash64(*more, *[x for k in keys for x in (F.col(k).isNull(), F.col(k))])
    texts = tokens.select(F.col("_pid").alias("pid"), F.col("_i").alias("i"), seed(F.lit(0)).alias("ga"), seed(F.lit(1)).alias("gb"), hashed().alias("a"), hashed(F.lit(1)).alias("b"))
    kind = "part int, n int, pid int, data binary"
    marks = texts.groupBy("pid").applyInPandas(asked(ranges), kind).groupBy("part", "n").applyInPandas(told, kind)
    lines = texts.groupBy("pid").cogroup(marks.groupBy("pid")).applyInPandas(gathered(ranges), kind)
    over = lines.groupBy("part", "n").applyInPandas(exceeded, "pid int, n int, data binary")
    return over.groupBy("pid").applyInPandas(summed, "_pid int, _i int, " + ", ".join(f"_over{n} long" for n in range(1, ORDERS + 1)))


def nearest_lengths(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """By group and length, the closest length of any other row, the shorter of two that are as close."""
    lengths = sizes.groupBy(*keys, "size").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys).orderBy("size")
    below, above = F.lag("size").over(w), F.lead("size").over(w)
    near = F.when(F.col("m") > 1, F.col("size")).when(below.isNull(), above).when(above.isNull() | (F.col("size") - below <= above - F.col("size")), below).otherwise(above)
    return lengths.select(*keys, "size", near.alias("reference"))


def looked_up(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, null keys being equal."""
    named = right.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(keys)})
    on = reduce(lambda x, y: x & y, [left[c].eqNullSafe(named[f"_{i}"]) for i, c in enumerate(keys)])
    return left.join(named, on, "left").drop(*[f"_{i}" for i in range(len(keys))])


def sentence_scores(rows: DataFrame, keys: list[str], row: str, text: str) -> DataFrame:
    """BLEU in 0 to 1 of each row against all others of its group, of orders 1 to 4 as far as the text is long.

    Orders without a match count half, a quarter, ... of one match. A row alone in its group has null, one without
    tokens or without a match 0. Row ids are distinct within a group; a null text has no tokens.
    """
    session = rows.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)  # a number of its own: by the texts' size alone there would be too few
    # texts go by row, so that their n-grams, which are many times as long, are counted where they are
    own = rows.select(*keys, F.col(row), F.col(text).alias("_text"))
    characters = own.agg(F.sum(F.length("_text"))).first()[0] or 0
    parts = max(parts, -(-characters // CHARACTERS))
    spread = own.withColumn("_pid", F.pmod(F.xxhash64(*keys, row), F.lit(parts)).cast("int")).repartition(parts, "_pid")
    placed = spread.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(*keys, row)) - 1)
    tokens = placed.select(*keys, row, "_pid", "_i", international(F.col("_text")).alias("tokens"))
    sizes = tokens.select(*keys, row, "_pid", "_i", F.size("tokens").alias("size"))
    over = excess(tokens, keys, parts)
    lengths = own.select(*keys, F.size(international(F.col("_text"))).alias("size"))  # where texts are read: they are not moved for it
    joined = looked_up(sizes, nearest_lengths(lengths, keys), [*keys, "size"]).join(over, ["_pid", "_i"], "left")
    joined = joined.select(*keys, row, "size", "reference", *[F.coalesce(F.col(f"_over{n}"), F.lit(0)).alias(f"over{n}") for n in range(1, ORDERS + 1)])
    total = {n: F.greatest(F.col("size") - n + 1, F.lit(0)) for n in range(1, ORDERS + 1)}
    matched = {n: total[n] - F.col(f"over{n}") for n in total}
    logs, halvings = F.lit(0.0), F.lit(0)
    for n in total:
        halvings = halvings + F.when((total[n] > 0) & (matched[n] == 0), 1).otherwise(0)
        share = F.when(matched[n] > 0, matched[n].cast("double")).otherwise(F.pow(F.lit(0.5), halvings))
        logs = logs + F.when(total[n] > 0, F.ln(share / total[n])).otherwise(0.0)
    orders = F.least(F.col("size"), F.lit(ORDERS))
    penalty = F.when(F.col("size") < F.col("reference"), F.exp(1 - F.col("reference") / F.col("size"))).otherwise(1.0)
    none = reduce(lambda a, b: a & b, [matched[n] == 0 for n in total])
    score = F.when(F.col("reference").isNull(), F.lit(None).cast("double")).when((F.col("size") == 0) | none, 0.0).otherwise(penalty * F.exp(logs / orders))
    return joined.select(*keys, row, score.alias("bleu"))


def self_bleu(rows: DataFrame, keys: list[str], row: str, text: str) -> DataFrame:
    """One line a group: its rows and the mean of their scores against each other; null for a single row."""
    return sentence_scores(rows, keys, row, text).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("bleu").alias("self_bleu"))
