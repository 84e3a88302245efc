"""Resampling against SQL that puts every n-gram together, and against its definition on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SMALL

from tallyloom.llm import common, registry, resample


def test_crcs_of_grams():
    rng = random.Random(5)
    texts = [b"", b" ", b"one", None, "É ist-x LONG".encode(), b"a" * 70_000 + b" " + b"b" * 3, *(" ".join(rng.choice(["ab", "Ü", "x1", "q" * rng.randint(1, 300)]) for _ in range(rng.randint(1, 40))).encode() for _ in range(50))]
    expected = []
    for n in (1, 2, 3):
        for k, t in enumerate(texts):
            w = (t or b"").translate(resample.FOLD).split()
            expected += [(zlib.crc32(b" ".join(w[i : i + n])), k) for i in range(len(w) - n + 1)]
    assert [(int(c), int(o)) for crcs, of in resample.gram_crcs(texts, 3) for c, o in zip(crcs, of, strict=True)] == expected


def test_powers_of_the_shift():
    crc = np.array([0, 1, 0xFFFFFFFF, 0x12345678], dtype=np.uint32)
    for length in (0, 1, 7, 255, 65_537):
        joined = [zlib.crc32(b"\0" * length, int(c)) ^ zlib.crc32(b"\0" * length) for c in crc]
        assert resample.shifted(crc, np.full(4, length)).tolist() == joined


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_same_rows_as_sql(spark, folder):
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = registry.QUERIES["op11_resampling"](spark, folder)
    assert got.columns == names
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, c.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES['op11_resampling']})").fetchall()))


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(g.encode()) % 50 for g in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:])))]


def brute(rows, target):
    source, wanted = Counter(b for _, t in rows for b in grams(t)[1]), Counter(b for t in target for b in grams(t)[1])
    s, t = sum(source.values()) + 50, sum(wanted.values()) + 50
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * s / ((source[b] + 1) * t))) for b in range(50)]
    out = []
    for d, text in rows:
        n, own = grams(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"3:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= 2), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 40 // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


def test_odd_rows(spark):
    rows = [(None, None), (None, "null ids"), (None, "null ids"), (1, ""), (2, " - !"), (3, "One"), (4, "é É 9"), (4, "é É 9"), *((k, "Very long " * 50_000 if k == 9 else f"same words {k % 3}") for k in range(5, 30))]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, rank int, N_Words string")
    target = spark.createDataFrame([("One word",), (None,), ("very Long",)], "text string")
    got = resample.resample(df, target, buckets=50, seed=3, least_words=2, percent=40).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, ["One word", "very Long"])
    assert resample.resample(df.limit(0), target).collect() == []
    alone = resample.resample(df, target.limit(0), buckets=50, seed=3, least_words=2, percent=40).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(repr, map(tuple, alone.collect()))) == brute(rows, [])


def test_places_of_a_hot_key(spark):
    """Equal keys share a range; places are still 1 to n without gaps, in order."""
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), "id").repartition(7)
    placed, total = common.numbered(df, [F.desc("k"), F.col("id")], "place")
    got = placed.orderBy("place").collect()
    assert total == 5000 and [r.place for r in got] == list(range(1, 5001))
    assert [(-r.k, r.id) for r in got] == sorted((-r.k, r.id) for r in got)
