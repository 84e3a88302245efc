"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every factor of all items. Documents are streamed through it;
at each word the length of the longest match that ends there is known, and with
it which windows of which items end there. The words of those windows are hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, raw, set_aside, stored, table, tidy

#: ASCII bytes other than digits and lower-case letters part words; bytes above 0x7F belong to them.
APART = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(APART).split() if text else []


class Builder:
    """A generalised suffix automaton that grows word by word."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self.split(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, q, c)
        return new

    def split(self, p: int, q: int, c: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def holder(self, state: int, n: int) -> int:
        """The state of the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


@dataclass(frozen=True)
class Automaton:
    """The finished automaton in arrays, some nine bytes for each of its text; fields are plain, so that they can be sent by themselves.

    keys and targets: transitions by state x words + word, sorted; link and length by state. Windows
    end in the states mark_states, sorted: window mark_sizes[i] of item mark_items[i]
    for i from mark_starts[k] to mark_starts[k + 1]. A window is the suffix of every string of its
    state that is as long. pairs: neighbours in some item.
    """

    items: list[str]
    vocabulary: dict[bytes, int]
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    mark_states: np.ndarray
    mark_starts: np.ndarray
    mark_sizes: np.ndarray
    mark_items: np.ndarray
    least: int
    pairs: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], window: int) -> Automaton:
        a, names, vocabulary, held = Builder(), [], {}, []
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            if ids:
                held.append((len(names), ids))
                names.append(name)
        for _, ids in held:
            last = 0
            for c in ids:
                last = a.extend(last, c)
        # only now are the states final, so only now are windows marked
        marks: dict[int, set] = {}
        for item, ids in held:
            n, state = min(window, len(ids)), 0
            for i, c in enumerate(ids):
                state = a.next[state][c]
                if i + 1 >= n:
                    marks.setdefault(a.holder(state, n), set()).add((n, item))
        least = min((min(window, len(ids)) for _, ids in held), default=0)
        n = len(vocabulary)
        pairs = np.unique(np.array([x * n + y for _, ids in held for x, y in pairwise(ids)], dtype=np.int64))
        edges = np.array(sorted((s * n + c, q) for s, own in enumerate(a.next) for c, q in own.items()), dtype=np.int64).reshape(-1, 2)
        states = sorted(marks)
        own = [m for s in states for m in sorted(marks[s])]
        starts = np.cumsum([0, *(len(marks[s]) for s in states)])
        return cls(
            names, vocabulary, edges[:, 0].copy(), edges[:, 1].astype(np.int32), np.array(a.link, np.int32), np.array(a.length, np.int32),
            np.array(states, np.int32), starts.astype(np.int32), np.array([m[0] for m in own], np.int32), np.array([m[1] for m in own], np.int32), least, pairs,
        )

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + 100 * (len(self.vocabulary) + len(self.items))

    def step(self, state: int, c: int) -> int:
        """The state after a word, 0 if there is none."""
        key = state * len(self.vocabulary) + c
        i = int(self.keys.searchsorted(key))
        return int(self.targets[i]) if i < len(self.keys) and self.keys[i] == key else 0

    def marks(self, state: int) -> list[tuple[int, int]]:
        k = int(self.mark_states.searchsorted(state))
        if k == len(self.mark_states) or self.mark_states[k] != state:
            return []
        x, y = self.mark_starts[k], self.mark_starts[k + 1]
        return list(zip(self.mark_sizes[x:y].tolist(), self.mark_items[x:y].tolist(), strict=True))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """The stretches in which a window can lie: at least `least` known words, each pair of neighbours in some item."""
        n = len(self.vocabulary)
        if self.least <= 1:
            keep = ids >= 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
            return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        left, right = ids[:-1], ids[1:]
        known = np.flatnonzero((left >= 0) & (right >= 0))
        codes = left[known] * n + right[known]
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        keep = np.zeros(len(left), dtype=np.int8)
        keep[known[self.pairs[at] == codes]] = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], keep, [0]])))
        return [(s, e + 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e + 1 - s >= self.least]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit stretches of words (start, end), items found, longest match."""
        if not self.items or len(words) < self.least:
            return [], set(), 0
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        most = 0
        for start, end in self.runs(ids):
            state = size = 0
            for i, c in enumerate(ids[start:end].tolist(), start):
                while not (after := self.step(state, c)) and state:
                    state = int(self.link[state])
                    size = int(self.length[state])
                state = after
                size = size + 1 if state else 0
                most = max(most, size)
                s, longest = state, 0
                while s > 0 and self.length[s] >= self.least:
                    for n, item in self.marks(s):
                        if n <= size:
                            longest = max(longest, n)
                            found.add(item)
                    s = int(self.link[s])
                if longest:
                    a = i + 1 - longest
                    if hits and a <= hits[-1][1]:
                        hits[-1] = (min(a, hits[-1][0]), i + 1)
                    else:
                        hits.append((a, i + 1))
        # a longer window may reach back over several earlier stretches
        merged: list[tuple[int, int]] = []
        for s, e in hits:
            while merged and s <= merged[-1][1]:
                s, e = min(s, merged[-1][0]), max(e, merged[-1][1])
                merged.pop()
            merged.append((s, e))
        return merged, found, most


def automata(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = 10, chunk_bytes: int = 2 << 20) -> DataFrame:
    """A table (chunk, nbytes, data) of automata over all items, each over about `chunk_bytes` of text (or one item).

    Items are dealt to chunks by a hash and built where they meet, in tasks: while it is built an automaton takes some
    eighty times its text, finished about nine times. The table is in the shared folder. Null texts and items without
    words are in none, items that repeat count once. No items, no automaton.
    """
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    dealt = items.withColumn("chunk", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    tasks = min(n, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, str | None, bytes]]:
            for batch in batches:
                yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chunk", "i")), raw(batch, "t"), strict=True)

        for chunk, own in groupby(rows(), key=lambda r: r[0]):
            made = Automaton.build([(i, t) for _, i, t in own], window)
            data = pickle.dumps(tuple(vars(made).values()), protocol=5)  # no class of ours: workers needn't have them
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([made.nbytes], pa.int64()), pa.array([data], pa.binary())], names=["chunk", "nbytes", "data"])

    work = dealt.repartition(tasks, "chunk").sortWithinPartitions("chunk", "i", "t").select("chunk", "i", "t")
    return stored(work.mapInArrow(tidy(run), "chunk long, nbytes long, data binary"), "automata")


def mark_contamination(docs: DataFrame, held: DataFrame, *, text: str = "text", pass_bytes: int = 256 << 20, also: tuple | None = None) -> DataFrame:
    """Add n_words, n_hit, items (sorted strings, a set), longest_match and hits (stretches of words).

    A null or empty text has no words and is hit nowhere; an item without words is
    never found; items of equal text are all found. Repeated rows give repeated
    results. Columns of the new names are replaced, others stay. Automata are sent out by passes of at most
    `pass_bytes` (or one), the driver and each worker holding one pass's worth; with more than one, documents pass
    through again, stored in between. `also` names two more columns and a function of text, n_words and hits that makes them, in the last pass.
    """
    spark = docs.sparkSession
    fields = [("n_words", "long"), ("hits", "array<struct<start:long,stop:long>>"), ("items", "array<string>"), ("longest_match", "long")]
    passes: list[list[int]] = [[]]
    size = 0
    for chunk, nbytes in sorted((r.chunk, r.nbytes) for r in held.select("chunk", "nbytes").collect()):  # a pair of numbers a chunk
        if passes[-1] and size + nbytes > pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append(chunk)
        size += nbytes
    out = docs
    for k, own in enumerate(passes):
        more = also if also and k == len(passes) - 1 else None
        before_this = stored(out, "hits") if k else out
        if k:
            sent.unpersist()  # what the pass before made is stored
        sent = spark.sparkContext.broadcast([bytes(r.data) for r in held.where(F.col("chunk").isin(own)).orderBy("chunk").collect()] if own else [])

        def make(sent=sent, k=k, more=more):
            automata = [Automaton(*pickle.loads(data)) for data in sent.value]

            def work(batch):
                rows = []
                before = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("hits", "items", "longest_match")] if k else None
                for i, t in enumerate(raw(batch, text)):
                    words = words_of(t)
                    hits, names, most = ([(h["start"], h["stop"]) for h in before[0][i]], set(before[1][i]), before[2][i]) if before else ([], set(), 0)
                    for a in automata:
                        spans, found, longest = a.scan(words)
                        hits += spans
                        names |= {a.items[x] for x in found}
                        most = max(most, longest)
                    hits = union(hits)
                    rows.append((len(words), [{"start": s, "stop": e} for s, e in hits], sorted(names), most, *(more[2](None if t is None else t.decode(), len(words), hits) if more else ())))
                return [[r[j] for r in rows] for j in range(6 if more else 4)]

            return work

        out = arrow_map(before_this, fields + ([(also[0], "string"), (also[1], "double")] if more else []), make)
    return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"]))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand, in code points."""
    at, out = None, []
    for i, ch in enumerate(text):
        if ch >= "\x80" or "0" <= ch <= "9" or "a" <= ch <= "z" or "A" <= ch <= "Z":
            at = i if at is None else at
        elif at is not None:
            out.append((at, i))
            at = None
    return out if at is None else [*out, (at, len(text))]


def remove_spans(docs: DataFrame, held: DataFrame, *, text: str = "text", least_hit: int = 1, coverage: float = 0.5) -> DataFrame:
    """Cut hit stretches of at least `least_hit` words out of texts; rows whose hit share is over `coverage` go.

    A null or empty text stays. What stands between the first and last hit word of a
    stretch is cut with it. Repeated rows fare alike, no rows give none, and all columns come back as
    they were, whatever their names.
    """
    own, back = set_aside(docs, ("n_words", "hits", "items", "longest_match", "n_hit", "_rest", "_share"))

    def cut(t: str | None, n: int, hits: list[tuple[int, int]]) -> tuple[str | None, float]:
        share = sum(e - s for s, e in hits) / n if n else 0.0
        hits = [(s, e) for s, e in hits if e - s >= least_hit]
        if hits:
            spans, parts, end = word_spans(t), [], 0
            for s, e in hits:
                parts.append(t[end : spans[s][0]])
                end = spans[e - 1][1]
            t = "".join([*parts, t[end:]])
        return t, share

    marked = mark_contamination(own, held, text=text, also=("_rest", "_share", cut))
    kept = marked.where(F.col("_share") <= coverage).withColumn(text, F.col("_rest"))
    return kept.select(*own.columns).withColumnsRenamed(back)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = automata(table(spark, sf_dir, "benchmark", "item_id", "text"))
    marked = mark_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), held).drop("text")
    return marked.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
    )
