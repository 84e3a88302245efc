"""Importance resampling towards a target: documents are drawn by how much their n-grams are like those of the target.

Features are word n-grams by the CRC of their text. Each distinct word's CRC is taken
once; those of n-grams follow from them, since appending b bytes multiplies a CRC by
the b-th power of a matrix over GF(2), whose powers of two are kept as byte tables.
No n-gram is ever put together as text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, arrow_map, numbered, raw, stored, table, tidy
from .wordhash import grouped

POLYNOMIAL = 0xEDB88320
#: Upper-case A-Z become lower-case; ASCII other than digits and letters parts words; all else belongs to them.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
BLANK = np.uint32(zlib.crc32(b" "))


@cache
def shift_tables(k: int) -> np.ndarray:
    """The matrix that appends 2 ** k zero bytes to a CRC, as what each value of each of its four bytes becomes."""
    if k:
        half = shift_tables(k - 1)
        columns = times(half, times(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):
            columns = (columns >> np.uint32(1)) ^ ((columns & np.uint32(1)) * np.uint32(POLYNOMIAL))
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> (bit & 7)) & 1 == 1
        tables[bit >> 3, has] ^= columns[bit]
    return tables


def times(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    low, eight = np.uint32(255), np.uint32(8)
    return tables[0][crcs & low] ^ tables[1][(crcs >> eight) & low] ^ tables[2][(crcs >> np.uint32(16)) & low] ^ tables[3][crcs >> np.uint32(24)]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC with as many zero bytes appended."""
    out = crcs.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = np.flatnonzero((lengths >> k) & 1)
        out[on] = times(shift_tables(k), out[on])
    return out


def word_crcs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of all words in order, and the number of words up to the end of each text."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer((b" ".join(parts) + b" ").translate(FOLD), dtype=np.uint8)
    space = data == 0x20
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
    distinct = np.fromiter(map(zlib.crc32, words.dictionary.to_pylist()), dtype=np.uint32, count=len(words.dictionary))
    edges = np.cumsum([len(p) + 1 for p in parts])
    return distinct[words.indices.to_numpy()], lengths, np.searchsorted(starts, edges)


def gram_crcs(texts: list[bytes | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to n the CRCs of all runs of that many words within a text, and the text of each."""
    words, lengths, ends = word_crcs(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    grams = words
    yield grams, of
    for k in range(1, n):
        if len(words) <= k:
            return
        with_blank = times(shift_tables(0), grams[:-1]) ^ BLANK
        grams = shifted(with_blank, lengths[k:]) ^ words[k:]
        inside = of[k:] == of[:-k]
        yield grams[inside], of[k:][inside]


def bucket_counts(df: DataFrame, *, n: int = 2, buckets: int = 10_000, text: str = "text") -> dict[int, int]:
    """How many features of all rows fall into each bucket. What reaches the driver is at most one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = raw(batch)
            for a, b in grouped(texts):
                for grams, _ in gram_crcs(texts[a:b], n):
                    total += np.bincount(grams % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    counted = df.select(F.col(text).alias("text")).mapInArrow(tidy(run), "bucket int, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log-ratio between target and source by bucket, each count raised by one."""
    s, t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(k, 0) + 1.0) * s / ((source.get(k, 0) + 1.0) * t))) for k in range(buckets)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, n: int = 2) -> DataFrame:
    """Add n_words, n_features and weight, the floored mean of the features' gains; the text goes.

    A null or empty text, or one without words, has no features and weight 0. Long texts count whole.
    """

    def make():
        def work(batch):
            texts = raw(batch)
            words, features, sums = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for a, b in grouped(texts):
                for k, (grams, of) in enumerate(gram_crcs(texts[a:b], n)):
                    found = np.bincount(of, minlength=b - a)
                    features[a:b] += found
                    if k == 0:
                        words[a:b] = found
                    sums[a:b] += np.bincount(of, weights=gain[grams % np.uint32(len(gain))], minlength=b - a).astype(np.int64)
            return [pa.array(x) for x in (words, features, sums // np.maximum(features, 1))]

        return work

    return arrow_map(docs, [("n_words", "long"), ("n_features", "long"), ("weight", "long")], make, drop=("text",))


def noise(seed: int) -> Column:
    """Thousandths of a Gumbel variate that follows from seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, *, n: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20, percent: int = 25) -> DataFrame:
    """Add n_words, n_features, weight, score and rank; the text goes.

    Of the rows with at least least_words words, the given share with the highest scores is drawn and ranked; equal
    scores go by doc_id, null ids last. A null or empty text has no features and weight 0. Equal rows have equal
    scores, in some fixed order. No rows give none, and without a target all of its counts are 0. Columns
    of the names added are replaced; others stay.
    """
    gain = gains(bucket_counts(docs, n=n, buckets=buckets), bucket_counts(target, n=n, buckets=buckets), buckets)
    kept = apart(docs, ["n_words", "n_features", "weight", "score", "rank"])
    scored = stored(weigh(docs.select(*kept), gain, n=n).withColumn("score", F.col("weight") + noise(seed)), "scores")
    ranked, total = numbered(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * total // 100, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The same with every n-gram as text and its CRC byte by byte.
ORACLE = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
worded AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w, row_number() OVER () AS r FROM documents
  UNION ALL
  SELECT 'b', 0, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), row_number() OVER () FROM benchmark),
feature AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded),
counted AS (SELECT kind, r, f, count(*) AS n FROM feature GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT f FROM counted)),
bucketed AS (SELECT f, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS k FROM bytes, steps),
placed AS (SELECT kind, r, k, sum(n)::BIGINT AS n FROM counted JOIN bucketed USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM placed),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(sum(n) FILTER (kind = 'b'), 0) + 1)::DOUBLE * (any_value(s) + 10000) / ((coalesce(sum(n) FILTER (kind = 'd'), 0) + 1)::DOUBLE * (any_value(t) + 10000))))::BIGINT AS g
  FROM placed, totals GROUP BY k),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM placed JOIN gain USING (k) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE kind = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY n >= 20) AS m FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND p <= (25 * m) // 100 THEN p END AS rank FROM ranked
"""
