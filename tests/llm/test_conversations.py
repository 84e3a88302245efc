"""Repair of conversations against a search over all edits, by both ways through the rows."""

import hashlib
import heapq
import re
import zlib

import pytest
from conftest import SMALL

from tallyloom.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def brute(rows):
    """Cheapest first, then least letters: the first complete sequence of edits is the answer."""
    seen, found = set(), []
    for _, _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        found.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {r[1] for r in rows} - {None}
    counts = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        state = (i, roles[-1:], len(roles) if len(roles) < 2 else 2)
        if state in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add(state)
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + name[0], (*lines, f"{name}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if found[i] not in ("blank", "duplicate"):
                extra = found[i] == "truncated"
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, roles + name[0], (*lines, f"{name}:{text}")))


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {c: brute(damaged(own)) for c, own in by.items()}


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


WAYS = [{}, {"long_rows": 3, "bits": 1}, {"long_rows": 0, "bits": 2}, {"long_bytes": 0, "bits": 12}]


@pytest.mark.parametrize("way", WAYS)
def test_against_search(spark, way):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA)), **way)) == expected(rows)


@pytest.mark.parametrize("way", WAYS)
def test_odd_rows(spark, way):
    long_ = "so it goes on. " * 60_000
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Hi."), (1, None, "system", "Be good."), (None, 1, "user", None), (None, None, None, "Who is it?"), (2, 0, "tool", "It is 7."), (2, 1, "", "So."), (2, 2, "under", "Kept."), (2, 3, "assistant", long_), (2, 9, "assistant", long_ + "or")]
    rows += [(10 + c, t, role, text) for c in range(40) for t, (role, text) in enumerate([("assistant", "A."), ("system", "S."), ("user", "A."), ("system", "no end"), ("user", " \t"), ("user", "É ist das?"), ("assistant", "A.")][c % 5 :])]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.selectExpr("*", "'x' AS audit", "1 AS cost", "2 AS gone")
    assert got(conversations.repair(conversations.damage(clashing), **way)) == expected(rows)
    assert conversations.repair(conversations.damage(df.limit(0)), **way).collect() == []


def test_all_rows_dropped(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = conversations.damage(spark.createDataFrame([(c, 0, "user", "Hi.")], SCHEMA))
    for way in WAYS:
        assert got(conversations.repair(df, **way)) == {c: (0, 0, 0, 0, 0, 0, "", EMPTY)}
