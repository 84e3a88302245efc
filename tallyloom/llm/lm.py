"""Language-model scores from a log-frequency Bloom filter.

Counts of bigrams are quantised to powers of a base. A bigram of level q is put into the
filter q times, as (bigram, 1) .. (bigram, q); a reader probes level after level until one is
missing. Word counts are exact. A word's probability after another is smoothed
with the word's own: (c(uv) + k P(v)) / (c(u) + k).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import apart, arrow_map, raw, release, remainder, stored, table, tidy
from .wordhash import grouped, mixed, words

#: The end of a text, a token of its own, and what stands before the first token. No word has these hashes but by chance.
END, START = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
#: Filter segments: all probes of a bigram fall into one.
SEGMENTS = 4096
#: What is sent to the workers at most; beyond it words and bigrams are asked for where their segment is.
FILTER_BYTES, VOCABULARY = 128 << 20, 8_000_000
FLUSH = 3 << 20
#: Text that asks the segments together, and text a task that answers, both in bytes.
CHUNK_BYTES, ASKED_BYTES = 16 << 20, 32 << 20
LOW = np.uint64(0xFFFFFFFF)


def token_arrays(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: tokens, the one before each, the bigrams, and where each text ends. Each text ends in END."""
    for a, b in grouped(texts):
        hashes, ends = words(texts[a:b])
        tokens = np.insert(hashes, ends, END)
        ends = ends + np.arange(1, len(ends) + 1)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], ends[:-1]])] = START
        yield tokens, before, mixed(mixed(before) * np.uint64(3) + tokens), ends


@dataclass(frozen=True)
class Counts:
    """words: (h, c); bigrams: (seg, h, c); tokens, distinct: N and V; texts: how many were learnt from."""

    words: DataFrame
    bigrams: DataFrame
    tokens: int
    distinct: int
    texts: int


def count(docs: DataFrame, *, text: str = "text") -> Counts:
    """Counts over all rows; a null text is an empty one, that is an end alone.

    Tasks count what they can hold before the shuffle, so frequent words and
    repeated texts arrive as few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, pairs = (np.concatenate([h[i] for h in held]) for i in range(2))
            for kind, x in ((0, tokens), (1, pairs)):
                h, c = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), pa.array(h.view(np.int64)), pa.array(c)], names=["kind", "h", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for tokens, _, pairs, _ in token_arrays(raw(batch.slice(at, 1024), text)):
                    held.append((tokens, pairs))
                    size += len(tokens)
                    if size >= FLUSH:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, 4 * docs.rdd.getNumPartitions())  # they grow with the input, however few partitions the session sets
    rows = docs.select(text).mapInArrow(tidy(run), "kind tinyint, h bigint, c bigint")
    dealt = rows.withColumn("seg", F.shiftrightunsigned("h", 52).cast("int")).repartition(tasks, "seg")
    both = stored(dealt.groupBy("seg", "kind", "h").agg(F.sum("c").alias("c")), "counts")
    single = both.where("kind = 0")
    n = single.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = single.where(F.col("h") == int(END.view(np.int64))).select("c").first()
    return Counts(single.select("h", "c"), both.where("kind = 1").select("seg", "h", "c"), n.n, n.v, ends.c if ends else 0)


@dataclass(frozen=True)
class Filter:
    """bits: SEGMENTS rows of bytes, or one, if all that is put and probed falls into it; probes: bits set for each level; base: of the quantised counts."""

    bits: np.ndarray
    probes: int
    base: float

    def spread(self, h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a level begin, and how far apart they are, modulo 2**32."""
        one = mixed(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        return one & LOW, (one >> np.uint64(32)) | np.uint64(1)

    def within(self, at: np.ndarray) -> np.ndarray:
        """Numbers below 2**32 to bits of a segment."""
        return (at * np.uint64(self.bits.shape[1] * 8)) >> np.uint64(32)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each bigram, 0 if it isn't there: probed until a level is missing."""
        flat = self.bits.reshape(-1)
        out = np.zeros(len(h), dtype=np.int16)
        segment = (h >> np.uint64(52)) * np.uint64(self.bits.shape[1] * 8) if len(self.bits) > 1 else np.zeros_like(h)
        left, level = np.arange(len(h)), 1
        while True:
            at, step = self.spread(h, level)
            for _ in range(self.probes):
                bit = segment + self.within(at)
                held = (flat[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not held.all():
                    h, left, segment, at, step = h[held], left[held], segment[held], at[held], step[held]
                at = (at + step) & LOW
            if not len(left):
                return out
            out[left] = level
            level += 1


def level_of(c: Column, base: float) -> Column:
    return (1 + F.floor(F.log(c.cast("double")) / math.log(base) + 1e-9)).cast("int")


def value_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The count that stands for a level: the middle of its least and greatest, 0 for level 0."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.ceil(base ** levels.astype(float) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def width_of(counts: Counts, base: float, bits_each: float = 10.0) -> int:
    """Bytes of a filter segment, from the number of levels to hold."""
    held = counts.bigrams.agg(F.coalesce(F.sum(level_of(F.col("c"), base).cast("long")), F.lit(0)).alias("n")).first().n
    return max(8, math.ceil(held * bits_each / 8 / SEGMENTS))


def build_filter(counts: Counts, width: int, *, base: float = 1.5, probes: int = 5, most_bytes: int = FILTER_BYTES) -> Filter | None:
    """The whole filter, or None if it would be larger than `most_bytes`."""
    if width * SEGMENTS > most_bytes:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        shape = Filter(np.zeros((1, width), np.uint8), probes, base)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            q = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(h)
            h, q = h[order], q[order]
            for level in range(1, int(q.max(initial=0)) + 1):
                own = h[q >= level]
                segment = (own >> np.uint64(52)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(segment, prepend=-1))
                at, step = shape.spread(own, level)
                for _ in range(probes):
                    inside = shape.within(at).astype(np.int64)
                    at = (at + step) & LOW
                    for s, part in zip(segment[cuts].tolist(), np.split(inside, cuts[1:]), strict=True):
                        made.setdefault(s, np.zeros(width * 8, dtype=bool))[part] = True
        data = [np.packbits(b, bitorder="little").tobytes() for b in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array(data, pa.binary())], names=["seg", "bits"])

    bits = np.zeros((SEGMENTS, width), dtype=np.uint8)
    rows = counts.bigrams.select("h", level_of(F.col("c"), base).alias("q")).mapInArrow(tidy(run), "seg int, bits binary")
    for r in stored(rows, "filter").toLocalIterator():
        bits[r.seg] |= np.frombuffer(r.bits, dtype=np.uint8)
    return Filter(bits, probes, base)


def segment_tables(counts: Counts, width: int, *, base: float = 1.5, probes: int = 5) -> DataFrame:
    """(seg, kind, a, b): for kind 0 a segment's word hashes and their counts, for kind 1 its filter bits in b.

    Counts lie by segment already, so nothing is shuffled; where a segment's file was read in parts, it has a row a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Filter(np.zeros((1, width), np.uint8), probes, base)
        flags, held, now = np.zeros(width * 8, dtype=bool), [], None

        def closed() -> pa.RecordBatch:
            if now[1]:
                a, b = None, np.packbits(flags, bitorder="little").tobytes()
                flags[:] = False
            else:
                a, b = (np.concatenate([x[i] for x in held]).tobytes() for i in range(2))
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int8()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["seg", "kind", "a", "b"])

        for batch in batches:
            seg, kind, h, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            h = h.view(np.uint64)
            cuts = np.flatnonzero(np.diff(seg.astype(np.int64) * 2 + kind, prepend=-1, append=-1))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now is not None and now != (seg[x], kind[x]):
                    yield closed()
                now = (int(seg[x]), int(kind[x]))
                own, of = h[x:y], c[x:y]
                if not now[1]:
                    held.append((own, of))
                    continue
                for level in range(1, int(of.max()) + 1):
                    own, of = own[of >= level], of[of >= level]
                    at, step = part.spread(own, level)
                    for _ in range(probes):
                        flags[part.within(at).astype(np.int64)] = True
                        at = (at + step) & LOW
        if now is not None:
            yield closed()

    seg = F.shiftrightunsigned("h", 52).cast("int").alias("seg")
    single = counts.words.select(seg, F.lit(0).cast("tinyint").alias("kind"), "h", "c")
    double = counts.bigrams.select("seg", F.lit(1).cast("tinyint").alias("kind"), "h", level_of(F.col("c"), base).cast("long").alias("c"))
    return stored(single.union(double).sortWithinPartitions("seg", "kind").mapInArrow(tidy(run), "seg int, kind tinyint, a binary, b binary"), "segments")


def answered(tables: DataFrame, asked: DataFrame, tasks: int, width: int, *, base: float = 1.5, probes: int = 5) -> DataFrame:
    """(chunk, seg, a, b): counts of the words and levels of the bigrams in the order they were asked for, 0 for what isn't there.

    asked: (seg, chunk, a, b), the sorted hashes of a chunk's words and bigrams in a segment. Questions go to where
    their segment's words and bits are; a task holds one segment at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Filter(np.zeros((1, width), np.uint8), probes, base)
        now, held, h, c = -1, [], np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            seg = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(seg, prepend=-1, append=-1))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if seg[x] != now:
                    now, held, h, c = int(seg[x]), [], np.empty(0, np.uint64), np.empty(0, np.int64)
                    part.bits[:] = 0
                chunks, asked = [], [[], []]
                for chunk, kind, a, b in zip(*(v.to_pylist() for v in batch.slice(x, y - x).columns[1:]), strict=True):
                    if kind == 0:
                        held.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
                    elif kind == 1:
                        part.bits[0] |= np.frombuffer(b, np.uint8)
                    else:
                        chunks.append(chunk)
                        asked[0].append(np.frombuffer(a, np.uint64))
                        asked[1].append(np.frombuffer(b, np.uint64))
                if not chunks:
                    continue
                if held:  # what a segment holds comes before those that ask
                    h, c = (np.concatenate([v[i] for v in held]) for i in range(2))
                    order = np.argsort(h)
                    h, c, held = h[order], c[order], []
                words, pairs = (np.concatenate(v) for v in asked)
                at = np.minimum(np.searchsorted(h, words), max(len(h) - 1, 0))
                seen = np.where(h[at] == words, c[at], 0) if len(h) else np.zeros(len(words), np.int64)
                found = []
                for values, v in ((seen.astype(np.int64), asked[0]), (part.levels(pairs).astype(np.uint8), asked[1])):
                    found.append(pa.array([p.tobytes() for p in np.split(values, np.cumsum([len(p) for p in v])[:-1])], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([now] * len(chunks), pa.int32()), *found], names=["chunk", "seg", "a", "b"])

    both = tables.select("seg", F.lit(-1).alias("chunk"), "kind", "a", "b").union(asked.select("seg", "chunk", F.lit(2).cast("tinyint"), "a", "b"))
    return both.repartition(tasks, "seg").sortWithinPartitions("seg", "chunk").mapInArrow(tidy(run), "chunk int, seg int, a binary, b binary")


def vocabulary(counts: Counts, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted hashes and counts of all words, or None if there are more than `most`."""
    if counts.distinct > most:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [c.to_numpy(zero_copy_only=False).tobytes() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], names=["h", "c"])

    h, c = np.empty(counts.distinct, np.uint64), np.empty(counts.distinct, np.int64)
    at = 0
    for r in stored(counts.words.mapInArrow(tidy(run), "h binary, c binary"), "words").toLocalIterator():
        n = len(r.h) // 8
        h[at : at + n], c[at : at + n] = np.frombuffer(r.h, np.uint64), np.frombuffer(r.c, np.int64)
        at += n
    order = np.argsort(h)
    return h[order], c[order]


FIELDS = [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")]


def score(docs: DataFrame, counts: Counts, *, text: str = "text", prior: float = 300.0, base: float = 1.5, filter_bytes: int = FILTER_BYTES, words_sent: int = VOCABULARY) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score; the text is dropped, other columns stay.

    base_score takes each token by itself, score takes it after the one before. If the filter and
    the words are small enough they are sent to the workers; if not, chunks of texts
    ask the filter's segments, which gives the same scores. A null or empty text is an end alone. With nothing learnt
    every token counts zero. Repeated rows get equal results; columns of the new names are replaced.
    """
    spark = docs.sparkSession
    total = max(counts.tokens + 0.5 * (counts.distinct + 1), 0.5)
    width = width_of(counts, base)
    held = build_filter(counts, width, base=base, most_bytes=filter_bytes)
    known = vocabulary(counts, words_sent) if held is not None else None
    if held is None or known is None:
        out = score_by_join(docs, counts, total, text, prior, base, width)
    else:
        sent = spark.sparkContext.broadcast((held.bits, held.probes, held.base, known, counts.texts))  # no class of ours: workers needn't have them

        def make():
            *parts, (h, c), texts = sent.value
            held = Filter(*parts)
            values = value_of(np.arange(200), held.base)

            def work(batch):
                out: list[list] = [[], [], [], []]
                for tokens, _, pairs, ends in token_arrays(raw(batch, text)):
                    unique, back = np.unique(tokens, return_inverse=True)
                    at = np.minimum(np.searchsorted(h, unique), max(len(h) - 1, 0))
                    seen = np.where(h[at] == unique, c[at], 0).astype(float) if len(h) else np.zeros(len(unique))
                    for k, x in enumerate(term_sums(seen[back], np.log10((seen + 0.5) / total)[back], values[held.levels(pairs)], ends, total, texts, prior)):
                        out[k] += x
                return out

            return work

        out = arrow_map(docs, FIELDS, make, drop=(text,), rows=4096)
    return out.withColumn("train_tokens", F.lit(counts.tokens).cast("long"))


def term_sums(own: np.ndarray, log: np.ndarray, counts: np.ndarray, ends: np.ndarray, total: float, texts: int, prior: float) -> list[list]:
    """The sums of FIELDS for each text, from the counts of all words, their logarithms and the counts of all bigrams, in order."""
    first = np.concatenate([[0], ends[:-1]])
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[first] = texts
    joint = np.log10((counts + (prior / total) * (own + 0.5)) / (context + prior))
    sums = [np.add.reduceat(x, first, dtype=t).tolist() for x, t in ((own > 0, np.int64), (log, float), (joint, float))]
    return [(ends - first).tolist(), *sums]


def score_by_join(docs: DataFrame, counts: Counts, total: float, text: str, prior: float, base: float, width: int, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same sums where filter or words are too large to send.

    Texts are dealt into chunks. A chunk asks each filter segment once, in one row, for all of its distinct words and
    bigrams, and gets counts and levels back in the order of the hashes, which are worked out anew beside the texts.
    So what is shuffled is the texts, eight bytes a distinct word or bigram of a chunk, and the answers, but no row a token.
    Rows that repeat in full share a chunk.
    """
    spark = docs.sparkSession
    kept = apart(docs, [n for n, _ in FIELDS])
    kept = [c for c in kept if c != text]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long") + 1), F.lit(0)).alias("n")).first().n
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    chunks = max(1, -(-size // chunk_bytes), min(tasks, -(-size // (1 << 20))))
    chunk = F.pmod(F.xxhash64(*docs.columns), F.lit(chunks)).cast("int")
    texts = counts.texts

    def deal(df: DataFrame) -> DataFrame:
        return df.repartitionById(chunks, "_chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, new, size = None, [[], []], 0

        def distinct() -> list[np.ndarray]:
            return [np.unique(np.concatenate(x)) for x in new]

        def closed() -> Iterator[pa.RecordBatch]:
            both = distinct()
            edges = np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(52)
            starts = [np.append(np.searchsorted(x, edges), len(x)).tolist() for x in both]
            for at in range(0, SEGMENTS, 512):  # rows of some megabytes together
                segs = [s for s in range(at, at + 512) if any(x[s] < x[s + 1] for x in starts)]
                if segs:
                    data = [pa.array([h[x[s] : x[s + 1]].tobytes() for s in segs], pa.binary()) for h, x in zip(both, starts, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int32()), pa.array([now] * len(segs), pa.int32()), *data], names=["seg", "chunk", "a", "b"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(ids, prepend=-1, append=-1))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now is not None and now != ids[x]:
                    yield from closed()
                    new, size = [[], []], 0
                now = int(ids[x])
                for tokens, _, pairs, _ in token_arrays(raw(batch.slice(x, y - x), text)):
                    new[0].append(tokens)
                    new[1].append(pairs)
                    size += len(tokens)
                    if size >= FLUSH:  # copies, however many, are held once
                        new, size = [[x] for x in distinct()], 0
        if now is not None:
            yield from closed()

    asked = deal(docs.select(chunk.alias("_chunk"), text)).sortWithinPartitions("_chunk").mapInArrow(tidy(ask), "seg int, chunk int, a binary, b binary")
    tables = segment_tables(counts, width, base=base)
    release(spark)  # what counting shuffled
    found = stored(answered(tables, asked, max(tasks, -(-size // ASKED_BYTES)), width, base=base), "answers")
    release(spark)

    schema = T.StructType([docs.schema[c] for c in kept] + T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in FIELDS)).fields)
    arrow = to_arrow_schema(T.StructType(schema.fields[len(kept) :]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = value_of(np.arange(256), base)
        now, answers, rows = None, [[], []], []

        def closed() -> Iterator[pa.RecordBatch]:
            parts = [p for batch in rows for p in token_arrays(raw(batch, text))]
            tokens, pairs = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
            (words, back), (bigrams, place) = (np.unique(x, return_inverse=True) for x in (tokens, pairs))
            c, q = np.frombuffer(b"".join(answers[0]), np.int64), np.frombuffer(b"".join(answers[1]), np.uint8)
            if len(c) != len(words) or len(q) != len(bigrams):
                raise RuntimeError("the rows to score changed while they were read")
            sizes = [len(p[0]) for p in parts]
            ends = np.concatenate([p[3] + at for p, at in zip(parts, np.cumsum([0, *sizes[:-1]]).tolist(), strict=True)])
            made = [pa.array(x, f.type) for x, f in zip(term_sums(c[back].astype(float), np.log10((c + 0.5) / total)[back], values[q[place]], ends, total, texts, prior), arrow, strict=True)]
            at = 0
            for batch in rows:
                columns = [batch.column(batch.schema.get_field_index(k)) for k in kept] + [x.slice(at, batch.num_rows) for x in made]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += batch.num_rows

        for batch in batches:
            ids, segs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = np.flatnonzero(np.diff(ids.astype(np.int64) * 2 + (segs == SEGMENTS), prepend=-1, append=-1))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now is not None and now != ids[x]:
                    yield from closed()
                    answers, rows = [[], []], []
                now, part = int(ids[x]), batch.slice(x, y - x)
                if segs[x] == SEGMENTS:  # texts come after their answers
                    rows.append(part)
                else:
                    for i in range(2):
                        answers[i] += part.column(2 + i).to_pylist()
        if now is not None:
            yield from closed()

    of = found.select(F.col("chunk").alias("_chunk"), F.col("seg").alias("_seg"), F.col("a").alias("_a"), F.col("b").alias("_b"), *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in [*kept, text]])
    own = docs.select(chunk.alias("_chunk"), F.lit(SEGMENTS).alias("_seg"), F.lit(None).cast("binary").alias("_a"), F.lit(None).cast("binary").alias("_b"), *kept, text)
    return deal(of.union(own)).sortWithinPartitions("_chunk", "_seg").mapInArrow(tidy(finish), schema)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", remainder("doc_id", 5) == 1)
    scored = score(docs, count(docs.where(~F.col("held_out"))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
