"""Best-fit packing of token pieces by minimum bin slack.

Only the histogram of piece lengths decides how pieces go together, and it has at
most as many entries as a sequence has tokens. So the driver searches over the
histogram: for each bin a bitset of reachable sums over the lengths still there
gives the fullest combination, which is then removed as often as the counts
allow. The outcome is a bounded list of intervals, "the pieces of this length with
these ranks go to these sequences at this offset"; the pieces themselves are ranked
within their length and placed on the executors.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, arrow_map, remembered, stored, table, texts, tidy

CAPACITY = 2048
CACHE_WORDS = 600_000

# The tokenizer's letters and numbers within Latin-1, lower case, and its cuts.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
EDGES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
VISIBLE = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")
#: What a byte-level vocabulary writes for bytes that have no sign of their own: the signs from 256 on, in order.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}


@dataclass(frozen=True)
class Interval:
    """Ranks first .. last - 1 of pieces of a length: `each` to a sequence from `sequence` on, the first at `offset`."""

    length: int
    first: int
    last: int
    each: int
    sequence: int
    offset: int


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination with the largest sum up to `room`, of the largest lengths that reach it.

    Bit s of a layer is set if some choice among the lengths so far sums to s. A
    count enters as binary multiples, so a length costs a logarithm of its count. Lengths
    enter from the largest on until the room is filled exactly, as nothing can be
    fuller; so large pieces, which are hard to place, go before small ones.
    """
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for n in reversed(lengths):
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            take = min(k, left)
            layers.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    sum_ = reach.bit_length() - 1
    chosen: Counter = Counter()
    for n, take, before in reversed(layers):
        if not before >> sum_ & 1:  # only this layer reached the sum
            chosen[n] += take
            sum_ -= n * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Interval], int]:
    """Intervals that place every piece, and the number of sequences.

    Each bin starts with the longest length left, which has to go somewhere and is
    the hardest to place; minimum bin slack fills the rest of it.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    used: Counter = Counter()
    out: list[Interval] = []
    sequence = 0
    lengths = sorted(left)
    while left:
        seed = lengths[-1]
        left[seed] -= 1
        chosen = Counter(fullest(left, lengths, capacity - seed))
        left[seed] += 1
        chosen[seed] += 1
        times = min(left[n] // k for n, k in chosen.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            out.append(Interval(n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            left[n] -= k * times
            offset += n * k
            if not left[n]:
                del left[n]
        lengths = sorted(left) if any(n not in left for n in chosen) else lengths
        sequence += times
    return out, sequence


class WordTokens:
    """Ids of a text from the ids of its white-space parts, which are remembered.

    Exact for tokenizers that lower case, cut at white space and at the edges of words as
    word_bpe_49k does: no id, and nothing that normalisation does, crosses such a cut.
    Texts within Latin-1, whose letters lower case and compose to themselves, are
    lowered whole and their parts cut once more, so that a word is encoded once
    whatever signs stand beside it; the tokenizer itself cuts other texts' parts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = Parts(self)
        self.others = Others(self)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, word: str) -> bytes:
        """The same for one word or run of signs as EDGES cuts them, which nothing cuts further or changes: the vocabulary's merges alone."""
        signs = word.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if len(self.parts) > CACHE_WORDS:
            self.parts.shrink()
        if len(self.others) > CACHE_WORDS:
            self.others.clear()
        try:
            parts, cache = text.lower().encode("latin-1").split(), self.parts
        except UnicodeEncodeError:
            parts = None
        if parts is None or "<|" in text:
            parts, cache = text.encode().split(), self.others
        return b"".join(map(cache.__getitem__, parts))


class Parts(dict):
    """Lower-case Latin-1 parts and their words; parts of visible signs only are cut into words, the others left to the tokenizer."""

    def __init__(self, own: WordTokens):
        self.own = own
        self.words: dict[bytes, bytes] = {}

    def shrink(self) -> None:
        """Words come again more often than parts with signs: they stay, unless they fill half of the room themselves."""
        if len(self.words) > CACHE_WORDS // 2:
            self.words.clear()
        self.clear()
        self.update(self.words)

    def __missing__(self, key: bytes) -> bytes:
        part = key.decode("latin-1")
        if VISIBLE.fullmatch(part):
            cut = EDGES.findall(part)
            found = b"".join([self[w.encode("latin-1")] for w in cut]) if len(cut) > 1 else self.words.setdefault(key, self.own.piece(part))
        else:
            found = self.own.encode(part)
        self[key] = found
        return found


class Others(dict):
    def __init__(self, own: WordTokens):
        self.own = own

    def __missing__(self, key: bytes) -> bytes:
        found = self[key] = self.own.encode(key.decode())
        return found


def pieces(docs: DataFrame, path: str, *, text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows to pieces: tokens plus `end_id`, cut only if longer than `capacity`; adds piece, start, length, ids_crc32.

    The path must be readable on the executors. A null text counts as empty: one piece
    with the end id alone. Columns of the new names are replaced, others but the
    text stay.
    """
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"

    def make():
        tokens = remembered(f"tokens {path}", lambda: WordTokens(path))

        def work(batch):
            out = []
            for t in texts(batch, text):
                data = tokens.ids(t) + end_id.to_bytes(4, "little")
                n, own = len(data) // 4, []
                for i, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    own.append({"piece": i, "start": start, "length": stop - start, "ids_crc32": zlib.crc32(data[4 * start : 4 * stop])})
                out.append(own)
            return [out]

        return work

    cut = arrow_map(docs, [("_pieces", kind)], make, drop=(text,), remember=True)
    kept = apart(cut, ["_pieces", "piece", "start", "length", "ids_crc32"])
    return cut.select(*kept, F.explode("_pieces").alias("_p")).select(*kept, "_p.*")


def pack(cut: DataFrame, *, length: str = "length", capacity: int = CAPACITY, salt_rows: int = 20_000, most_salts: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to `capacity`.

    The rows are written to the shared folder once, so that ranks and histogram see
    the same rows even if executors are lost. A length is split by a hash of the row into
    salts of about `salt_rows` rows (more only where all together would pass `most_salts`),
    so that a frequent one isn't ranked by one task and the driver sees at most
    `capacity` + `most_salts` counts. Equal rows are told apart by their place in that
    table. No rows, no sequences.
    """
    spark = cut.sparkSession
    kept = apart(cut, ["sequence_id", "offset"])
    numbered = stored(cut.select(*kept, F.monotonically_increasing_id().alias("_row")), "pieces")
    sizes = {r.n: r.c for r in numbered.groupBy(F.col(length).alias("n")).agg(F.count("*").alias("c")).collect()}  # capacity rows at most
    each = max(salt_rows, sum(sizes.values()) // most_salts + 1)
    several = [F.lit(x) for n, c in sizes.items() if c > each for x in (n, -(-c // each))]
    salts = F.coalesce(F.create_map(*several)[F.col(length).cast("long")], F.lit(1)) if several else F.lit(1)
    salted = numbered.withColumn("_salt", F.pmod(F.xxhash64("_row"), salts).cast("int"))
    counts = salted.groupBy(F.col(length).alias("n"), "_salt").agg(F.count("*").alias("c")).collect()
    histogram: Counter = Counter()
    base: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r.n, r["_salt"])):
        base[r.n, r["_salt"]] = histogram[r.n]
        histogram[r.n] += r.c
    intervals, _ = plan(histogram, capacity)
    by_length: dict[int, list[Interval]] = {}
    for i in intervals:
        by_length.setdefault(i.length, []).append(i)
    places = {n: np.array([(i.first, i.each, i.sequence, i.offset) for i in own]).T for n, own in by_length.items()}
    sent = spark.sparkContext.broadcast((base, places))
    tasks = max(1, min(len(counts), max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(sizes.values()) // (10 * salt_rows))))

    def run(batches):
        import pyarrow as pa

        base, places = sent.value
        seen: Counter = Counter()
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            salt = batch.column(batch.schema.get_field_index("_salt")).to_numpy(zero_copy_only=False)
            rank = np.empty(len(n), dtype=np.int64)
            order = np.lexsort((salt, n))
            first = np.flatnonzero(np.concatenate([[True], (np.diff(n[order]) != 0) | (np.diff(salt[order]) != 0)])) if len(n) else []
            for x, y in zip(first, [*first[1:], len(n)], strict=True):
                key = int(n[order[x]]), int(salt[order[x]])
                rank[order[x:y]] = base[key] + seen[key] + np.arange(y - x)
                seen[key] += int(y - x)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(n).tolist():
                own = np.flatnonzero(n == x)
                first, each, at, off = places[x]
                k = np.searchsorted(first, rank[own], side="right") - 1
                past = rank[own] - first[k]
                sequence[own] = at[k] + past // each[k]
                offset[own] = off[k] + past % each[k] * x
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([numbered.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # all rows of a length and salt meet in one task, and are ranked in an order of their own: a repeated task deals the same places
    return salted.repartition(tasks, length, "_salt").sortWithinPartitions(length, "_salt", "_row").mapInArrow(tidy(run), schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
