"""Repair of conversations whose turns don't follow system?, (user, assistant)+.

What the cheapest edits cost from each row and state of the grammar is worked out
backwards; a walk forwards then takes, of the edits that keep to that cost, the one
whose letter is least, and rebuilds the turns. Conversations of up to LONG_ROWS rows
and LONG_BYTES of text are repaired where their rows meet. Longer ones are cut into
blocks: a block's costs are a 4 x 4 matrix, matrices are chained per conversation,
and the blocks are walked from every state, so that no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, table, tidy

#: Conversations above either bound go through blocks of 1 << BLOCK_BITS rows.
LONG_ROWS, LONG_BYTES, BLOCK_BITS = 50_000, 32 << 20, 12
#: States: nothing yet, after system, after user, after assistant. What follows by a row of each initial, and by an added or renamed one.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
OTHER = (2, 2, 3, 2)
NAMES = (None, "system", "user", "assistant")
INF = 1 << 60
ENDS = [0, 4, 2, 0]
LEGAL = ("su", "ua", "au")
VISIBLE = re.compile("[^\\x20\\x09-\\x0D]")
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: A row for the costs: its role's initial, whether it has to go, and whether it is cut short.
Row = tuple[str, bool, bool]


def before(row: Row, after: list[int]) -> list[int]:
    """What is left to pay in each state before a row, from what is left after it."""
    initial, gone, short = row
    least = [3 + c for c in after]
    if not gone:
        keep = AFTER.get(initial)
        for q in range(4):
            least[q] = min(least[q], 2 + short + after[OTHER[q]])
            if keep and keep[q] is not None:
                least[q] = min(least[q], short + after[keep[q]])
    return added(least)


def added(least: list[int]) -> list[int]:
    """The costs where turns may also be added: after user an assistant, else a user."""
    u, a = min(least[2], 2 + least[3]), min(least[3], 2 + least[2])
    return [min(least[0], 2 + u), min(least[1], 2 + u), u, a]


def costs_to_go(rows: list[Row], end: list[int]) -> list[list[int]]:
    out = [end]
    for row in reversed(rows):
        out.append(before(row, out[-1]))
    return out[::-1]


def walk(rows: list[Row], costs: list[list[int]], q: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The moves (letter, state after, row) of least letters at that cost, and the last state.

    Unless these rows are the last ones, turns added after them are left to what follows.
    """
    moves, i, n = [], 0, len(rows)
    while i < n or (last and costs[i][q] > 0):
        here = costs[i][q]
        keep = None
        if i < n:
            initial, gone, short = rows[i]
            keep = None if gone or initial not in AFTER else AFTER[initial][q]
        if i < n and here == 3 + costs[i + 1][q]:
            moves.append(("D", q, i))
            i += 1
        elif here == 2 + costs[i][OTHER[q]]:
            q = OTHER[q]
            moves.append(("I", q, i))
        elif keep is not None and here == short + costs[i + 1][keep]:
            q = keep
            moves.append(("K", q, i))
            i += 1
        else:
            q = OTHER[q]
            moves.append(("R", q, i))
            i += 1
    return moves, q


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text), or nothing."""
    seen, out = set(), []
    for role, text in rows:
        key = (role, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        if not VISIBLE.search(text):
            out.append("blank")
        elif key in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(BLANKS)[-1] in ".!?" else "truncated")
        seen.add(key)
    return out


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The COUNTS of one conversation's (turn, role, text) rows, in order."""
    found = faults([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    plain = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found)]
    costs = costs_to_go(plain, ENDS)
    moves, _ = walk(plain, costs, 0, True)
    lines = [f"{rows[i][1] if m == 'K' else NAMES[q]}:{'' if m == 'I' else rows[i][2]}" for m, q, i in moves if m != "D"]
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, costs[0][0], "".join(m for m, _, _ in moves), digest


def damage(rows: DataFrame) -> DataFrame:
    """The rows with damage by crc32 of conv_id:turn modulo 20; a dropped one stays as a row that is marked `gone`.

    Null values count as one space, but a null turn stays null and a null conv_id is a conversation of its own.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    marked = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    twice = marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_n"))
    return twice.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def in_order(rows: DataFrame, *, spread: bool) -> DataFrame:
    """Rows by conversation and turn (nulls first); equal turns go by role and a digest of the text.

    They are dealt by conversation, or, with `spread`, by the whole order, so that one conversation takes many tasks.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_digest")]
    rows = rows.withColumn("_digest", F.unhex(F.sha2("text", 256)))
    return (rows.repartitionByRange(*order) if spread else rows.repartition("conv_id")).sortWithinPartitions(*order)


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, rows) for each run of equal conv_id; rows are read as they come and must be read before the next run."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                yield from zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", *columns)], strict=True)

    source = rows()
    held = next(source, None)
    while held is not None:
        key, first = held[0], held
        following: list = [None]

        def own() -> Iterator[tuple]:
            yield first[1:]
            for row in source:
                if row[0] != key:
                    following[0] = row
                    return
                yield row[1:]

        yield key, own()
        held = following[0]


def emitted(made: Iterator[tuple], schema: pa.Schema, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in made:
        held.append(row)
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def streamed(rows: DataFrame, columns: list[str], fields: str, work) -> DataFrame:
    """work(conv_id, rows) gives the result rows of each run of a conversation, in a task that only holds what work() does."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emitted(((key, *made) for key, own in runs(batches, columns) for made in work(key, own)), arrow)

    return rows.select("conv_id", *columns).mapInArrow(tidy(run), schema)


def repair_short(rows: DataFrame) -> DataFrame:
    def work(_, own):
        yield repaired([(turn, role, text) for turn, role, text, gone in own if not gone])

    return streamed(in_order(rows, spread=False), ["turn", "role", "text", "gone"], COUNTS, work)


def codes(role: Column, gone: Column, short: Column) -> Column:
    """A row for the costs as one number."""
    initial = F.substring(role, 1, 1)
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return at + F.when(gone, 4).otherwise(0) + F.when(short, 8).otherwise(0)


def plain_rows(packed: list[int]) -> list[Row]:
    return [("sua?"[c & 3], bool(c & 4), bool(c & 8)) for c in packed]


def repair_long(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The same for conversations of any length, by blocks of at most 2 ** bits rows.

    Only the digest of a repaired conversation is taken by one task, which reads the turns in order and holds
    none: SHA-256 can't be split.
    """
    held = stored(in_order(rows.where(~F.col("gone")), spread=True).withColumn("_at", F.monotonically_increasing_id()), "turns")
    whole = held.withColumn("_block", F.shiftright("_at", bits))
    blank = ~F.col("text").rlike(VISIBLE.pattern)
    flags = whole.select("conv_id", "_block", "_at", "turn", "role", "_digest", blank.alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("open"))
    often = flags.where(~F.col("blank")).groupBy("conv_id", "role", "_digest").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    keys = often.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_digest").alias("_d"), "_first")
    joined = flags.join(keys, flags["conv_id"].eqNullSafe(keys["_c"]) & (flags["role"] == keys["_r"]) & (flags["_digest"] == keys["_d"]) & ~flags["blank"], "left")
    again = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    told = joined.withColumn("duplicate", again).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    code = codes(F.col("role"), F.col("blank") | F.col("duplicate"), F.col("truncated"))
    per = told.groupBy("conv_id", "_block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", code.alias("c")))), lambda x: x["c"]).alias("codes"),
        F.min("_at").alias("first"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
    )

    def matrix(_, own):
        for block, packed, first in own:
            turns = plain_rows(packed)
            columns = [costs_to_go(turns, [0 if q == k else INF for q in range(4)])[0] for k in range(4)]
            yield block, packed, first, [columns[k][q] for q in range(4) for k in range(4)]

    def suffixes(_, own):
        """Blocks come last first: what is left to pay after each."""
        end, last = ENDS, True
        for block, packed, first, m in own:
            yield block, packed, first, end, last
            end, last = [min(INF, min(m[4 * q + k] + end[k] for k in range(4))) for q in range(4)], False

    def walked(_, own):
        for block, packed, first, end, last in own:
            turns = plain_rows(packed)
            costs = costs_to_go(turns, end)
            done = [walk(turns, costs, q, last) for q in range(4)]
            seams = [sum(a[0] + b[0] not in LEGAL for a, b in zip(turns, turns[1:])), turns[0][0], turns[-1][0]]
            yield block, first, len(turns), ["".join(f"{m}{q}" for m, q, _ in moves) for moves, _ in done], [q for _, q in done], costs[0][0], last, seams[0], seams[1] + seams[2]

    def entered(_, own):
        """Blocks come in order: the state in which each is entered, and so its edits."""
        q, ended = 0, ""
        for k, (block, first, n, letters, exits, cost, last, illegal, edge) in enumerate(own):
            seam = int(bool(ended) and ended + edge[0] not in LEGAL)
            yield block, first, n, letters[q], cost if k == 0 else None, illegal + seam
            q, ended = exits[q], edge[1]

    by_block = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    squares = streamed(per, ["_block", "codes", "first"], "_block long, codes array<int>, first long, m array<long>", matrix)
    ends = streamed(by_block(squares, F.desc("_block")), ["_block", "codes", "first", "m"], "_block long, codes array<int>, first long, after array<long>, last boolean", suffixes)
    ways = streamed(ends.repartition("conv_id", "_block"), ["_block", "codes", "first", "after", "last"], "_block long, first long, n int, letters array<string>, exits array<int>, cost long, last boolean, illegal long, edge string", walked)
    edits = stored(streamed(by_block(ways, "_block"), ["_block", "first", "n", "letters", "exits", "cost", "last", "illegal", "edge"], "_block long, first long, n int, letters string, cost long, illegal long", entered), "edits")

    def pieces(_, own):
        """For each row what is added before and after it, and as what it stays (K: as it is)."""
        for block, first, n, letters in own:
            at, out = 0, [["", None, ""] for _ in range(n)]
            for m, q in zip(letters[::2], letters[1::2]):
                if m == "I":
                    out[min(at, n - 1)][0 if at < n else 2] += f"{NAMES[int(q)]}:\n"
                    continue
                if m != "D":
                    out[at][1] = NAMES[int(q)] if m == "R" else "K"
                at += 1
            yield from ((block, first + k, *row) for k, row in enumerate(out))

    shown = streamed(edits, ["_block", "first", "n", "letters"], "_block long, _at long, pre string, kind string, post string", pieces)
    given = shown.select(F.col("conv_id").alias("_c"), F.col("_at").alias("_p"), "pre", "kind", "post").where("pre != '' OR kind IS NOT NULL OR post != ''")
    lines = whole.join(given, whole["conv_id"].eqNullSafe(given["_c"]) & (whole["_at"] == given["_p"]))

    def digest(_, own):
        h, empty = hashlib.sha256(), True
        for _, role, text, pre, kind, post in own:
            line = "" if kind is None else f"{role if kind == 'K' else kind}:{text}\n"
            for part in (pre, line, post):
                if part:
                    h.update(((("" if empty else "\n") + part[:-1])).encode("utf-8", "surrogatepass"))
                    empty = False
        yield (h.hexdigest(),)

    sums = streamed(by_block(lines, "_at"), ["_at", "role", "text", "pre", "kind", "post"], "repaired_sha256 string", digest)
    faulty = per.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audits = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "letters"))), lambda x: x["letters"]), ""), "0123", "").alias("audit"))
    turns = whole.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = rows.select("conv_id").distinct()
    for k, part in enumerate((turns, faulty, audits, sums)):
        part = part.withColumnRenamed("conv_id", f"_k{k}")
        out = out.join(part, out["conv_id"].eqNullSafe(part[f"_k{k}"]), "left").drop(f"_k{k}")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select("conv_id", *[F.coalesce(F.col(f.name), F.lit(empty.get(f.name, 0)).cast(f.dataType)).alias(f.name) for f in T._parse_datatype_string(COUNTS).fields])


def repair(rows: DataFrame, *, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, bits: int = BLOCK_BITS) -> DataFrame:
    """One row a conversation of damage()d rows: faults, the cheapest edits and the digest of the repaired turns.

    Null turns come first; equal turns go by role and a digest of the text. A null conv_id is a conversation. One
    without rows, or whose rows are all gone, has zeros and the digest of nothing. Roles by other names than system,
    user and assistant go by their initial where it is one of theirs, and are renamed or deleted otherwise. No rows
    give none; other columns aren't carried, since rows are summed up.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_b"))
    long_ = stored(sizes.where((F.col("_n") > long_rows) | (F.col("_b") > long_bytes)).select(F.col("conv_id").alias("_long")), "long")
    if long_.isEmpty():
        return repair_short(rows)
    same = rows["conv_id"].eqNullSafe(long_["_long"])
    return repair_short(rows.join(long_, same, "left_anti")).unionByName(repair_long(rows.join(long_, same, "left_semi"), bits))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
