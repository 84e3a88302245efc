"""Languages of texts by character trigrams, with profiles counted from labelled rows of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources import folders

#: A profile holds this many of a language's most frequent trigrams.
PROFILE = 2000
#: Signs that are taken apart together, and languages that are held against a text together.
SIGNS, SIDE = 1 << 21, 32


def signs(text: Column) -> Column:
    """The lower-case text, in which all that isn't a letter is one blank; at either end too."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " ")), F.lit(" "))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of three signs, as numbers, and where each text's begin. Texts have three signs at least."""
    ends = np.cumsum([len(s) for s in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    within = np.ones(len(codes), bool)
    within[ends - 1] = within[ends - 2] = False
    keys = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[within[:-2]]
    return keys, np.concatenate([[0], ends[:-1] - 2 * np.arange(1, len(ends))]).astype(np.int64)


def spelled(key: int) -> str:
    return chr(key >> 42) + chr(key >> 21 & 0x1FFFFF) + chr(key & 0x1FFFFF)


def bundles(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of SIGNS together, or of one that is longer."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SIGNS:
            yield start, i
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (language, gram, c), each once a bundle."""
    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in bundles([len(s) for s in texts]):
            own: dict[str, list[str]] = {}
            for name, s in zip(names[a:b], texts[a:b], strict=True):
                own.setdefault(name, []).append(s)
            for name, some in own.items():
                keys, c = np.unique(trigrams(some)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array([spelled(k) for k in keys.tolist()], pa.string()), pa.array(c, pa.int64())], names=["language", "gram", "c"])


def profiles(rows: DataFrame, text: str, language: str, size: int = PROFILE) -> DataFrame:
    """language, gram and weight: how much likelier a trigram is in the language than one that isn't in its profile.

    `base` is the logarithm of the latter's chance. Rows without a label teach nothing. Trigrams are counted where the
    texts are, then added up and ranked, so a language with most of the rows is no heavier than a rare one. The counts are
    stored, so texts are taken apart once however often a profile is read.
    """
    told = rows.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), signs(F.col(text)).alias("s")).where(F.length("s") > 2)
    each = told.mapInArrow(counted, "language string, gram string, c bigint")
    path = folders.fresh_path(rows.sparkSession, "trigrams")
    each.groupBy("language", "gram").agg(F.sum("c").alias("c")).write.parquet(path)
    counts = rows.sparkSession.read.schema("language string, gram string, c bigint").parquet(path)
    totals = counts.groupBy("language").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("c"), "gram"))).where(F.col("r") <= size)
    scale = F.col("n") + 0.5 * (F.col("v") + 1)
    return top.join(totals, "language").select("language", "gram", (F.ln(F.col("c") + 0.5) - F.ln(F.lit(0.5))).alias("weight"), F.ln(0.5 / scale).alias("base"))


def sides(profile: DataFrame) -> list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """The profile by SIDE languages in the order of their names: these, their bases, the trigrams and a row of weights a language (0 for a trigram that isn't there)."""
    own: dict[str, list] = {}
    for r in profile.select("language", "gram", "weight", "base").collect():
        own.setdefault(r.language, []).append(r)
    names = sorted(own, key=str.encode)
    out = []
    for at in range(0, len(names), SIDE):
        some = names[at : at + SIDE]
        number = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
        grams = np.array(sorted({number(r.gram) for n in some for r in own[n]}), np.int64)
        weights = np.zeros((len(some), len(grams) + 1))
        for i, n in enumerate(some):
            weights[i, np.searchsorted(grams, [number(r.gram) for r in own[n]])] = [r.weight for r in own[n]]
        out.append((some, np.array([own[n][0].base for n in some]), grams, weights))
    return out


def languages(rows: DataFrame, key: str, text: str, profile: DataFrame) -> DataFrame:
    """key, language and n (trigrams): the language whose profile makes the text likeliest, the first by name of equals.

    null for a text without a letter, and where there is no profile. The profile has at most PROFILE rows a language
    and goes to the rows, so texts are judged where they are and nothing is shuffled. Blanks are never neighbours, so each
    trigram has a letter and they are as many as the signs less two.
    """
    known = sides(profile)

    def judged(texts: list[str]) -> list[str | None]:
        keys, starts = trigrams(texts)
        n = np.array([len(s) - 2 for s in texts], float)
        best, names = np.full(len(texts), -np.inf), np.full(len(texts), None, object)
        for some, bases, grams, weights in known:
            at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            at[grams[at] != keys] = len(grams)
            for name, base, w in zip(some, bases.tolist(), weights, strict=True):
                score = np.add.reduceat(w[at], starts) + n * base
                names[score > best] = name
                best = np.maximum(best, score)
        return names.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            told: list[str | None] = [None] * len(texts)
            for a, b in bundles([len(s) for s in texts]):
                at = [i for i in range(a, b) if len(texts[i]) > 2]
                if at and known:
                    for i, name in zip(at, judged([texts[i] for i in at]), strict=True):
                        told[i] = name
            n = pa.array([max(len(s) - 2, 0) for s in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), n], names=[key, "language", "n"])

    shape = T.StructType([rows.schema[key], T.StructField("language", T.StringType()), T.StructField("n", T.LongType())])
    return rows.select(key, signs(F.col(text)).alias("_s")).mapInArrow(run, shape)
