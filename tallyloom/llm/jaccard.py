"""N-gram Jaccard join with a prefix tree.

Exact, in steps that each grow in proportion to the input:

1. Texts become sets of shingles. Equal sets form a class, told by a digest; each class has
   a signature, the parities of about twice as many parts as it has shingles. Two signatures
   differ in at most as many bits as there are shingles in one set only.
2. Shingles are ordered by how frequent their hash bucket is, rare ones first. Two
   sets that link share one of the first |set| - ceil(t |set|) + 1 of that order,
   at places and with lengths that still allow the overlap, and their signatures don't
   rule the link out. Groups of up to PAIRS sets that share a shingle give such pairs; larger
   groups get the signatures of their rows and give only the edges that span them; a group
   over HOT rows is cut into salted blocks that share some leaders, and only rows that
   no leader reaches meet the other blocks.
3. Connected pairs form a bundle. No link leaves a bundle, nearly all are small, and
   each set goes to one bundle only.
4. A bundle's sets are stored in a prefix tree, frequent shingles first. Each set walks the
   tree, sharing partial overlaps; a subtree is left when the lengths that remain
   can't reach the threshold or when all its sets are already connected to the set.
   Bundles too large for a task are cut by their distances from pivots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, raw, release, set_aside, stored, table, tidy
from .wordhash import shingle_sets

BUCKETS = 1 << 22
BLOCK = 1 << 14
#: Groups of a shingle up to this size give all pairs that the filters leave.
PAIRS = 16
#: Rows of a group that one task holds; leaders that the blocks of a larger group share.
HOT, LEADERS = 4096, 16
#: Sets of a bundle that one task joins, their bytes, and classes and edges that a task remembers.
BUNDLE, BUNDLE_BYTES = 8192, 64 << 20
SEEN = 500_000
#: Row numbers that are broadcast at most, eight bytes each.
SENT_ROWS = 2_000_000
#: Bits that say which classes are in a bundle; others pass by chance and go in a join.
BITMAP = 1 << 27


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def node_column(digest: Column | str) -> Column:
    """node_of() as an expression."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


def signature(s: np.ndarray) -> bytes:
    """Parities of a power of two of parts, 64 and twice the set's size at least."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    part = ((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=bits) & 1, bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """At least this many shingles are in one of the two sets only; a longer signature is folded."""
    x, y, p, q = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while p > q:
        p //= 2
        x = (x >> p) ^ (x & ((1 << p) - 1))
    while q > p:
        q //= 2
        y = (y >> q) ^ (y & ((1 << q) - 1))
    return (x ^ y).bit_count()


def near_test(percent: int) -> Callable[[tuple, tuple], bool]:
    """Whether two rows (node, n, place, signature) that share a shingle may link."""

    def near(x: tuple, y: tuple) -> bool:
        n, m = x[1], y[1]
        if n * 100 < percent * m or m * 100 < percent * n or min(n - x[2], m - y[2]) * (100 + percent) < percent * (n + m):
            return False
        return differ(x[3], y[3]) * (100 + percent) <= (100 - percent) * (n + m)

    return near


def classify(docs: DataFrame, *, text: str = "text", size: int = 5) -> tuple[DataFrame, np.ndarray, int]:
    """Rows without the text but with n_shingles, _digest and _signature (null where the task has given it); counts of shingles by bucket; the mean count.

    Counts are summed in blocks by tasks, so what reaches the driver is BUCKETS numbers.
    """
    kept = [c for c in apart(docs, ["n_shingles", "_digest", "_signature", "_block", "_counts"]) if c != text]
    new = T._parse_datatype_string("n_shingles bigint, _digest binary, _signature binary, _block int, _counts binary")
    nullable = [T.StructField(c, docs.schema[c].dataType, True) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int32)
        kinds, seen = None, set()
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in kept]
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, digests, signatures = [], [], []
                for s in shingle_sets(raw(part, text), size):
                    n.append(len(s))
                    digests.append(digest_of(s) if len(s) else None)
                    signatures.append(signature(s) if len(s) and digests[-1] not in seen else None)
                    seen.add(digests[-1])
                    if len(seen) > SEEN:
                        seen.clear()
                    counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)] += 1
                none = pa.nulls(len(n))
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                made = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *new.names])
        blocks, data = blocks_of(counts)
        if blocks:
            none = pa.nulls(len(blocks))
            made = [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[none.cast(k) for k in kinds], *made], names=[*kept, *new.names])

    both = stored(docs.select(*kept, text).mapInArrow(tidy(run), T.StructType([*nullable, *new.fields])), "classes")

    counts = summed(both.where("_block is not null").select("_block", "_counts"))
    return both.where("_block is null").drop("_block", "_counts"), counts, int(counts.mean()) + 1


def blocks_of(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    blocks = [i for i in range(BUCKETS // BLOCK) if counts[i * BLOCK : (i + 1) * BLOCK].any()]
    return blocks, [zlib.compress(counts[i * BLOCK : (i + 1) * BLOCK].astype(np.int64).tobytes(), 1) for i in blocks]


def summed(blocks: DataFrame) -> np.ndarray:
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(c), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["_block", "_counts"])

    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in blocks.repartition(BUCKETS // BLOCK, "_block").mapInArrow(tidy(total), "_block int, _counts binary").collect():
        counts[r["_block"] * BLOCK : (r["_block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(r["_counts"]), dtype=np.int64)
    return counts


def frequency_classes(counts: np.ndarray, mean: int) -> np.ndarray:
    """Half powers of two above the mean: coarse, so that chance differences don't matter."""
    return np.clip(np.floor(2 * np.log2(np.maximum(counts, 1) / mean)), 0, 255).astype(np.uint8)


def ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set with rare shingles first; ties by hash, which a sorted set brings along."""
    return s[np.argsort(classes[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")]


def prefix_groups(docs: DataFrame, classes, percent: int, *, text: str = "text", size: int = 5) -> DataFrame:
    """Pairs (a, b) of classes from small groups, where token is null; rows (token, a, n, place) of larger groups, where b is null."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = classes.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows: list[list[np.ndarray]] = [[], [], [], []]
                for s in shingle_sets(raw(batch.slice(at, 512), text), size):
                    n = len(s)
                    if not n or (node := node_of(digest_of(s))) in seen:
                        continue
                    seen.add(node)
                    if len(seen) > SEEN:
                        seen.clear()
                    p = n - -(-percent * n // 100) + 1
                    rows[0].append(ordered(s, known)[:p].view(np.int64))
                    rows[1].append(np.full(p, node, dtype=np.int64))
                    rows[2].append(np.full(p, n, dtype=np.int32))
                    rows[3].append(np.arange(p, dtype=np.int32))
                columns = [np.concatenate(r) if r else np.empty(0, k) for r, k in zip(rows, (np.int64, np.int64, np.int32, np.int32), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "place"])

    def pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = [np.empty((2, 0), dtype=np.int64)]
        for g in np.unique(sizes).tolist():
            start = first[sizes == g]
            for i in range(g):
                for j in range(i + 1, g):
                    x, y = start + i, start + j
                    reach = np.minimum(n[x] - place[x], n[y] - place[y])
                    good = (n[x] * 100 >= percent * n[y]) & (reach * (100 + percent) >= percent * (n[x] + n[y]))
                    out.append(np.stack([node[x[good]], node[y[good]]]))
        return np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows in; the last group waits while it is small, and the rows of a large one pass at once."""
        carry, passing = [np.empty(0, dtype=np.int64)] * 4, None

        def made(columns: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal carry, passing
            token, node = columns[:2]
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n, place = columns = [c[fresh] for c in columns]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, dtype=np.int64)
            sizes = np.diff(np.append(first, len(token)))
            large = (sizes > PAIRS) | (token[first] == passing if passing is not None else False)
            carry = [c[:0] for c in columns]
            waits = bool(len(first)) and not last and not large[-1]
            if waits:
                carry = [c[first[-1] :].copy() for c in columns]
            passing = int(token[-1]) if len(first) and large[-1] else None
            small = ~large & (sizes > 1)
            if waits:
                small[-1] = False
            found = pairs(token, node, n, place, first[small], sizes[small])
            out = np.repeat(large, sizes)
            rows = int(out.sum())
            none = pa.nulls(found.shape[1], pa.int64())
            join = [
                pa.concat_arrays([none, pa.array(token[out], pa.int64())]),
                pa.array(np.concatenate([found[0], node[out]]), pa.int64()),
                pa.concat_arrays([pa.array(found[1], pa.int64()), pa.nulls(rows, pa.int64())]),
                pa.concat_arrays([none.cast(pa.int32()), pa.array(n[out].astype(np.int32))]),
                pa.concat_arrays([none.cast(pa.int32()), pa.array(place[out].astype(np.int32))]),
            ]
            return pa.RecordBatch.from_arrays(join, names=["token", "a", "b", "n", "place"])

        for batch in batches:
            yield made([np.concatenate([old, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for old, c in zip(carry, batch.columns, strict=True)], False)
        yield made(carry, True)

    rows = docs.select(text).mapInArrow(tidy(prefixes), "token bigint, node bigint, n int, place int")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    grouped = rows.repartition(tasks, "token").sortWithinPartitions("token", "n", "node")
    return stored(grouped.mapInArrow(tidy(spans), "token bigint, a bigint, b bigint, n int, place int"), "groups")


def signed_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(i).to_pylist() for i in range(2, 6))
            good = [differ(p, q) * (100 + percent) <= (100 - percent) * (i + j) for p, q, i, j in zip(x, y, n, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = signatures.select(F.col("node").alias("a"), F.col("signature").alias("x"), F.col("n").alias("n"))
    two = signatures.select(F.col("node").alias("b"), F.col("signature").alias("y"), F.col("n").alias("m"))
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y", "n", "m")
    return both.mapInArrow(tidy(run), "a bigint, b bigint")


class Links:
    """What a task knows to be connected; edges come out only when they connect something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.new: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.parent[x] = y
            self.new.append((a, b))

    def taken(self) -> pa.RecordBatch:
        out, self.new = self.new, []
        if len(self.parent) > SEEN:
            self.parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in range(2)], names=["a", "b"])


def span(rows: list[tuple], links: Links, near: Callable[[tuple, tuple], bool]) -> None:
    """Connect all rows (node, n, place, signature) that may link; rows that are connected already aren't compared."""
    parts: dict[int, list[tuple]] = {}
    for x in sorted(rows, key=lambda r: r[1]):
        own = [x]
        for k in list(parts):
            if links.top(parts[k][0][0]) == links.top(x[0]) or any(near(x, y) for y in reversed(parts[k])):
                links.join(x[0], parts[k][0][0])
                own = parts.pop(k) + own
        parts[x[0]] = own


def large_groups(rows: DataFrame, signatures: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """Edges that span the candidates of groups over PAIRS rows."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = rows.select("token", F.col("a").alias("node"), "place").dropDuplicates(["token", "node"]).join(signatures, "node").select("token", "node", "n", "place", "signature")
    counted = rows.groupBy("token").agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot)
    rows = rows.join(stored(counted, "hot"), "token", "left").withColumn("salts", F.coalesce(F.ceil(F.col("_rows") / hot).cast("int"), F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    leads = F.expr(f"salts > 1 AND pmod(xxhash64(node, 1), _rows) < {LEADERS}")
    held = stored(rows.withColumn("leads", F.coalesce(leads, F.lit(False))).drop("_rows"), "large-groups")
    blocks = held.where("NOT leads").unionByName(held.where("leads").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))

    names = ("token", "node", "n", "place", "signature", "salts", "salt", "leads")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of each block; of a group with several blocks also (node, null) for rows that its first leader doesn't reach, with token and salt."""
        links, near, key, group = Links(), near_test(percent), None, []

        def done() -> list[pa.RecordBatch]:
            span([g[:4] for g in group], links, near)
            rest = []
            if group and group[0][4] > 1:
                first = min((g[0] for g in group if g[5]), default=None)
                rest = [g[0] for g in group if not g[5] and (first is None or links.top(g[0]) != links.top(first))]
            edges = links.taken()
            none, left = pa.nulls(edges.num_rows, pa.int64()), pa.array(rest, pa.int64())
            nothing = pa.nulls(len(rest), pa.int64())
            out = [pa.RecordBatch.from_arrays([edges.column(0), edges.column(1), none], names=["a", "b", "token"])]
            if rest:
                out.append(pa.RecordBatch.from_arrays([left, nothing, pa.array([key[0]] * len(rest), pa.int64())], names=["a", "b", "token"]))
            return out

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for token, node, n, place, sign, salts, salt, lead in zip(*columns, strict=True):
                if (token, salt) != key:
                    yield from done()
                    key, group = (token, salt), []
                group.append((node, n, place, sign, salts, lead))
        yield from done()

    found = stored(blocks.repartition(tasks, "token", "salt").sortWithinPartitions("token", "salt").mapInArrow(tidy(within), "a bigint, b bigint, token bigint"), "spans")
    edges = found.where("token is null").select("a", "b")
    rest = found.where("token is not null").select("token", F.col("a").alias("node"))
    if rest.isEmpty():
        return edges
    # rows that no block connected to the group's first leader meet all blocks, in chunks
    chunks = rest.groupBy("token").agg(F.ceil(F.count("*") / hot).cast("int").alias("chunks"))
    here = held.join(chunks, "token")
    alone = here.join(rest, ["token", "node"], "left_semi").withColumns({"chunk": F.pmod(F.xxhash64("node", F.lit(2)), "chunks").cast("int"), "salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "alone": F.lit(True)})
    others = here.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "alone": F.lit(False)})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, near, key, group = Links(), near_test(percent), None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("token", "salt", "chunk", "alone", "node", "n", "place", "signature")]
            for token, salt, chunk, alone_, *row in zip(*columns, strict=True):
                if (token, salt, chunk) != key:
                    key, group = (token, salt, chunk), []
                if alone_:
                    group.append(tuple(row))
                    continue
                for x in group:
                    if x[0] != row[0] and links.top(x[0]) != links.top(row[0]) and near(x, row):
                        links.join(x[0], row[0])
            yield links.taken()

    columns = ["token", "salt", "chunk", "alone", "node", "n", "place", "signature"]
    work = alone.select(*columns).unionByName(others.select(*columns)).repartition(tasks, "token", "salt", "chunk")
    return edges.union(work.sortWithinPartitions("token", "salt", "chunk", F.desc("alone")).mapInArrow(tidy(across), "a bigint, b bigint"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes with an edge: root is the smallest node reachable.

    Large-star and small-star steps, alternating until nothing changes; each round is a
    table in the shared folder. Rounds grow with the logarithm of the longest path; if so many
    are not enough, that is an error and not a result.
    """
    both = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        # large star: larger neighbours of a node go to its smallest neighbour (or itself)
        near = both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.where("a <> b")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        both = stored(small, "edges")
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return both.select(F.col("a").alias("node"), F.col("b").alias("root")).union(both.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


class Tree:
    """A compressed prefix tree of sorted sets. Nodes are ranges of the sets in lexicographic order."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = [len(s) for s in self.sets]
        n = len(sets)
        self.parent = list(range(n))
        common = [self.shared(self.sets[i], self.sets[i + 1]) for i in range(n - 1)]
        #: start and end depth, first and last + 1 set, children, least and greatest size, a set if all are connected, else -1
        self.nodes: list[list] = []
        self.root = self.build(common)

    @staticmethod
    def shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def build(self, common: list[int]) -> int:
        """By a stack over the depths that neighbours share, without recursion."""
        sizes = self.sizes

        def node(end: int, first: int, last: int, children: list[int]) -> int:
            own = sizes[first:last]
            self.nodes.append([0, end, first, last, children, min(own), max(own), first if last == first + 1 else -1])
            for c in children:
                self.nodes[c][0] = end
            return len(self.nodes) - 1

        stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # depth, first set, children
        for i in range(len(sizes)):
            depth = common[i - 1] if i else 0
            last = None
            while stack[-1][0] > depth:
                d, first, children = stack.pop()
                children = children + ([last] if last is not None else [])
                last = node(d, first, i, children)
                if stack[-1][0] < depth:
                    stack.append((depth, self.nodes[last][2], []))
            if last is not None:
                stack[-1][2].append(last)
            elif stack[-1][0] < depth:
                raise AssertionError("depths out of order")
            if sizes[i] > stack[-1][0]:
                stack.append((sizes[i], i, []))
        last = None
        while len(stack) > 1:
            d, first, children = stack.pop()
            last = node(d, first, len(sizes), children + ([last] if last is not None else []))
            if stack[-1][0] < d and len(stack) == 1:
                break
        return node(0, 0, len(sizes), stack[0][2] + ([last] if last is not None else []))

    def top(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, i: int, mark: np.ndarray, percent: int) -> None:
        """Connect set i, whose shingles are marked, with all later sets that link and aren't connected yet."""
        nodes, sizes, top = self.nodes, self.sizes, self.top
        m, own = sizes[i], self.sets[i]
        todo = [(self.root, 0)]
        while todo:
            at, overlap = todo.pop()
            start, end, first, last, children, least, most, one = nodes[at]
            if last <= i or (one >= 0 and top(one) == top(i)) or least * percent > 100 * m or most * 100 < percent * m:
                continue
            if end > start:
                overlap += int(np.count_nonzero(mark[self.sets[first][start:end]]))
            reached = self.sets[first][end - 1] if end else -1
            rest = min(m - int(np.searchsorted(own, reached, side="right")), most - end) if end else min(m, most)
            if (overlap + rest) * (100 + percent) < percent * (m + max(least, end)):
                continue
            if sizes[first] == end and first > i and 100 * overlap >= percent * (m + end - overlap):
                a, b = top(first), top(i)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            if children:
                roots = {top(nodes[c][7]) if nodes[c][7] >= 0 else -1 - c for c in children}
                if len(roots) == 1 and (r := next(iter(roots))) >= 0 and (sizes[first] > end or top(first) == r):
                    nodes[at][7] = first
                todo += [(c, overlap) for c in children]

    def connect(self, percent: int, labels: list | None = None) -> list[int]:
        """For each set, in the order given, a number that is the same for connected ones. Sets of equal label start connected."""
        if labels is not None:
            seen: dict = {}
            for i, k in enumerate(self.order):
                if labels[k] is not None and (j := seen.setdefault(labels[k], i)) != i:
                    self.parent[self.top(i)] = self.top(j)
        mark = np.zeros(1 + max((int(s[-1]) for s in self.sets if len(s)), default=0), dtype=bool)
        for i, s in enumerate(self.sets):
            mark[s] = True
            self.link(i, mark, percent)
            mark[s] = False
        out = [0] * len(self.order)
        for i, k in enumerate(self.order):
            out[k] = self.top(i)
        return out


def ranked(sets: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    """Shingles as small numbers, frequent ones first."""
    every = np.unique(np.concatenate(sets))
    c = classes[(every & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int16)
    rank = np.empty(len(every), dtype=np.uint32)
    rank[np.lexsort((every, -c))] = np.arange(len(every), dtype=np.uint32)
    return [np.sort(rank[np.searchsorted(every, s)]) for s in sets]


class Members:
    """Says of a node whether it may be in a bundle: a bitmap of a fixed size, put together by the tasks, is sent to the workers."""

    def __init__(self, bundles: DataFrame, bits: int = BITMAP):
        at = F.pmod("node", F.lit(bits)) + 1
        parts = bundles.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
        held = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
        for r in parts.collect():
            held[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bitmap, dtype=np.uint8)
        self.bits, self.sent = bits, bundles.sparkSession.sparkContext.broadcast(held)

    def may_hold(self, node: int) -> bool:
        at = node % self.bits
        return bool(self.sent.value[at >> 3] >> (at & 7) & 1)


def member_sets(docs: DataFrame, bundles: DataFrame, *, text: str = "text", size: int = 5) -> DataFrame:
    """(root, digest, shingles) of each class in a bundle; once, or once for each task that meets a copy."""
    members = Members(bundles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for s in shingle_sets(raw(batch.slice(at, 256), text), size):
                    if len(s) and (d := digest_of(s)) not in seen and members.may_hold(node := node_of(d)):
                        seen.add(d)
                        out.append((node, d, s.tobytes()))
                        if len(seen) > SEEN:
                            seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["node", "digest", "shingles"])

    found = docs.select(text).mapInArrow(tidy(run), "node bigint, digest binary, shingles binary")
    return found.join(bundles, "node").select("root", "digest", "shingles")


def join_blocks(rows: DataFrame, keys: list[str], classes, percent: int) -> DataFrame:
    """(digest, label): rows of equal keys joined by a tree; label is the smallest digest connected within the block.

    A column `label` among the rows says which are connected already.
    """
    given = "label" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        key = None

        def done() -> pa.RecordBatch:
            sets = ranked([np.frombuffer(h[0], dtype=np.uint64) for h in held.values()], classes.value) if held else []
            names = list(held)
            tops = Tree(sets).connect(percent, [h[1] for h in held.values()] if given else None) if sets else []
            least: dict[int, bytes] = {}
            for d, t in zip(names, tops, strict=True):
                least[t] = min(d, least.get(t, d))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([least[t] for t in tops], pa.binary())], names=["digest", "label"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "digest", "shingles", *["label"] * given)]
            for values in zip(*columns, strict=True):
                if (k := values[: len(keys)]) != key:
                    if held:
                        yield done()
                    key, held = k, {}
                held[values[len(keys)]] = [values[len(keys) + 1], values[-1] if given else None]
        yield done()

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "digest binary, label binary")


def join_large(rows: DataFrame, classes, percent: int, bundle: int, pivots: int = 6) -> DataFrame:
    """(digest, label) edges of bundles that one task can't hold.

    Jaccard distance is a metric. In each round a bundle's rest has a pivot, whose distance to
    all is measured; sets within the threshold form its ball and are connected. Then the balls
    and the rest are cut into blocks by distance from the bundle's first pivot, and only those
    pairs of blocks are joined that hold sets of different balls and whose distances differ
    by no more than a link allows.
    """
    spark = rows.sparkSession
    most = 1 - percent / 100
    state = stored(rows.withColumns({"ball": F.lit(None).cast("binary"), "far": F.lit(None).cast("double")}), "balls")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pivot = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shingles", "_pivot"))
            out = []
            for a, b in zip(own, pivot, strict=True):
                if b is None:
                    out.append(None)
                    continue
                x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                o = len(np.intersect1d(x, y, assume_unique=True))
                out.append((len(x) + len(y) - 2 * o) / (len(x) + len(y) - o))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "_d"])

    for k in range(pivots):
        left = state.where("ball is null")
        chosen = left.groupBy("root").agg(F.min_by(F.struct("digest", "shingles"), "digest").alias("p"), F.count("*").alias("n")).where((F.col("n") > bundle) | F.lit(k == 0))
        near = state.join(F.broadcast(chosen.select("root", F.col("p.digest").alias("_name"), F.col("p.shingles").alias("_pivot"))), "root", "left")
        measured = near.mapInArrow(tidy(measure), T.StructType([*near.schema.fields, T.StructField("_d", T.DoubleType())]))
        inside = F.col("ball").isNull() & (F.col("_d") <= most + 1e-12)
        state = stored(measured.select("root", "digest", "shingles", F.when(inside, F.col("_name")).otherwise(F.col("ball")).alias("ball"), F.coalesce("far", "_d").alias("far")), "balls")
        if not state.where("ball is null").groupBy("root").count().where(F.col("count") > bundle).limit(1).count():
            break
    # blocks: a ball's or the rest's sets by distance from the first pivot, at most bundle / 2 each
    from pyspark.sql import Window

    numbered = state.withColumn("_i", F.row_number().over(Window.partitionBy("root", "ball", F.floor(F.col("far") * 64)).orderBy("far", "digest")))
    block = numbered.withColumn("_b", F.struct("ball", F.floor(F.col("far") * 64).alias("ring"), F.floor((F.col("_i") - 1) / (bundle // 2)).alias("k")))
    blocks = block.groupBy("root", "_b").agg(F.min("far").alias("lo"), F.max("far").alias("hi"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a._b") <= F.col("b._b")) & (F.col("a.lo") - F.col("b.hi") <= most + 1e-9) & (F.col("b.lo") - F.col("a.hi") <= most + 1e-9))
    pairs = pairs.where(F.col("a._b.ball").isNull() | F.col("b._b.ball").isNull() | (F.col("a._b.ball") != F.col("b._b.ball")))
    named = pairs.select(F.col("a.root").alias("root"), F.xxhash64("a.root", "a._b", "b._b").alias("pair"), F.explode(F.array("a._b", "b._b")).alias("_b")).distinct()
    work = named.join(block, ["root", "_b"]).select("root", "pair", "digest", "shingles", F.col("ball").alias("label"))
    links = join_blocks(work, ["root", "pair"], classes, percent)
    return links.union(state.where("ball is not null").select("digest", F.col("ball").alias("label")))


def labelled(docs: DataFrame, *, text: str = "text", size: int = 5, percent: int = 75, bundle: int = BUNDLE, hot: int = HOT) -> tuple[DataFrame, list[str]]:
    """Rows with n_shingles, _digest and _label, which names the component and is null for a row without shingles; and the columns but these two."""
    spark = docs.sparkSession
    rows, counts, mean = classify(docs, text=text, size=size)
    classes = spark.sparkContext.broadcast(frequency_classes(counts, mean))
    groups = prefix_groups(docs, classes, percent, text=text, size=size)
    release(spark)
    signatures = rows.where("_signature is not null").select(node_column("_digest").alias("node"), F.col("n_shingles").alias("n"), F.col("_signature").alias("signature")).dropDuplicates(["node"])
    rows = rows.drop("_signature")
    edges = signed_pairs(groups.where("token is null"), signatures, percent).union(large_groups(groups.where("token is not null"), signatures, percent, hot))
    bundles = components(edges)
    sizes = bundles.join(signatures, "node").groupBy("root").agg(F.count("*").alias("n"), (8 * F.sum("n")).alias("bytes"))
    large = stored(sizes.where((F.col("n") > bundle) | (F.col("bytes") > BUNDLE_BYTES)).select("root"), "large")
    some = not large.isEmpty()
    members = member_sets(docs, bundles, text=text, size=size)
    if some:
        members = stored(members, "members")
    labels = join_blocks(members.join(large, "root", "left_anti") if some else members, ["root"], classes, percent)
    if some:
        links = stored(join_large(members.join(large, "root").dropDuplicates(["digest"]), classes, percent, bundle), "links")
        names = links.select(node_column("digest").alias("a"), node_column("label").alias("b"))
        far = components(names).select(F.col("node").alias("_n"), F.col("root").cast("string").cast("binary").alias("_r"))
        own = links.select("digest").distinct()
        labels = labels.union(own.join(far, node_column("digest") == F.col("_n")).select("digest", F.col("_r").alias("label")))
    labels = stored(labels.where("digest <> label"), "labels")
    named = rows.join(labels.select(F.col("digest").alias("_digest"), F.col("label").alias("_label")), "_digest", "left")
    return named.withColumn("_label", F.coalesce("_label", "_digest")), [c for c in rows.columns if c != "_digest"]


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, bundle: int = BUNDLE, hot: int = HOT) -> DataFrame:
    """Add n_shingles and component_id (the smallest key reachable by links); the text is dropped, other columns stay.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. A row
    without words (a null or empty text) has no shingles and is alone; equal rows are
    linked. A null key is passed over unless a component has no other. An empty
    table gives an empty result; columns of the new names are replaced.
    """
    named, columns = labelled(docs, text=text, size=size, percent=percent, bundle=bundle, hot=hot)
    least = named.where("_label is not null").groupBy("_label").agg(F.min(key).alias("_least"))
    out = named.join(least, "_label", "left").withColumn("_own", F.coalesce("_least", key))
    return out.select(*[c for c in columns if c.lower() != "component_id"], F.col("_own").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each component, that of the smallest key; of rows that share it, null keys included, one.

    Rows are told apart by a number of their own, so a shared or null key neither loses nor saves a row. The numbers of
    rows that go are broadcast if there are at most SENT_ROWS of them; if more, the rows pass through a shuffle.
    """
    own, back = set_aside(docs, ("_row",))
    numbered = stored(own.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found, _ = labelled(numbered.select("_row", key, text), text=text, **settings)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "_row"))["_row"]
    chosen = found.where("_label is not null").groupBy("_label").agg(first.alias("_row")).select("_row")
    gone = stored(found.where("_label is not null").select("_row").join(chosen, "_row", "left_anti"), "gone")
    few = gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return numbered.join(F.broadcast(gone) if few else gone, "_row", "left_anti").select(*own.columns).withColumnsRenamed(back)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")
