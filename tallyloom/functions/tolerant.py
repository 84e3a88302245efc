"""JSON as models write it, brought to strict JSON: a push-down automaton over tokens.

Strings may be in single or triple quotes and hold line ends, keys and words may stand
without quotes, commas may trail, double or be missing, and what is open at the end is
closed. Text that is JSON already is left alone and never reaches Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTES = ("'''", '"""', "'", '"')
BARE = re.compile(r"[^\s{}\[\]:,'\"]+")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "nan": "null"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
CLOSING = {"{": "}", "[": "]"}
MOST_DEPTH = 200


def tokens(s: str, at: int) -> Iterator[tuple[str, str]]:
    """("s", text of a string), ("w", bare word) or (sign, "") from a place on; an open string goes to the end."""
    while at < len(s):
        c = s[at]
        if c.isspace():
            at += 1
            continue
        quote = next((q for q in QUOTES if s.startswith(q, at)), None)
        if quote in ("'''", '"""'):
            end = s.find(quote, at + 3)
            yield "s", s[at + 3 : end if end >= 0 else len(s)]
            at = end + 3 if end >= 0 else len(s)
        elif quote:
            out, at = [], at + 1
            while at < len(s) and s[at] != quote:
                if s[at] == "\\" and at + 1 < len(s):
                    code = re.compile("u([0-9a-fA-F]{4})").match(s, at + 1)
                    out.append(chr(int(code[1], 16)) if code else ESCAPES.get(s[at + 1], s[at + 1]))
                    at += len(code[0]) + 1 if code else 2
                else:
                    out.append(s[at])
                    at += 1
            yield "s", "".join(out)
            at += 1
        elif c in "{}[]:,":
            yield c, ""
            at += 1
        else:
            word = BARE.match(s, at)
            yield "w", word[0]
            at = word.end()


def plain(kind: str, text: str) -> str:
    """A value as JSON. Lone halves of surrogate pairs become question marks."""
    if kind == "w":
        if text.lower() in WORDS:
            return WORDS[text.lower()]
        if NUMBER.match(text):
            digits = re.sub(r"^(-?)0+(?=\d)", r"\1", re.sub(r"^(-?)\.", r"\g<1>0.", text.lstrip("+")))
            return re.sub(r"\.(?=$|[eE])", ".0", digits)
    return json.dumps(text.encode("utf-8", "replace").decode(), ensure_ascii=False)


def repaired(s: str) -> str | None:
    """The first object or array of a text as strict JSON; what follows its end is left out. None if there is none, or it nests too deep."""
    found = re.search(r"[{\[]", s)
    if not found:
        return None
    out: list[str] = []
    stack: list[list] = []  # [bracket, what may come next, has entries]; in objects key, colon or value

    def entry() -> None:
        """Before a value or key: the comma that belongs there, and none elsewhere."""
        top = stack[-1]
        if top[1] in ("key", "item"):
            if top[2]:
                out.append(",")
            top[2] = True

    def done() -> None:
        top = stack[-1]
        top[1] = "key" if top[0] == "{" else "item"

    def close() -> None:
        bracket, state, _ = stack.pop()
        if state == "colon":
            out.append(":null")
        elif state == "value":
            out.append("null")
        out.append(CLOSING[bracket])
        if stack:
            done()

    for kind, text in tokens(s, found.start()):
        if kind in ("{", "["):
            if stack:
                if stack[-1][1] == "key":
                    continue  # no bracket can be a key
                if stack[-1][1] == "colon":
                    out.append(":")
                entry()
            stack.append([kind, "key" if kind == "{" else "item", False])
            if len(stack) > MOST_DEPTH:
                return None
            out.append(kind)
        elif kind in ("}", "]"):
            if any(CLOSING[b] == kind for b, _, _ in stack):
                while CLOSING[stack[-1][0]] != kind:
                    close()
                close()
            if not stack:
                break
        elif kind == ":":
            if stack[-1][1] == "colon":
                out.append(":")
                stack[-1][1] = "value"
        elif kind == ",":
            if stack[-1][1] in ("colon", "value"):
                out.append(":null" if stack[-1][1] == "colon" else "null")
                done()
        elif stack[-1][1] == "key":
            entry()
            out.append(plain("s", text))
            stack[-1][1] = "colon"
        else:
            if stack[-1][1] == "colon":
                out.append(":")
            entry()
            out.append(plain(kind, text))
            done()
    while stack:
        close()
    return "".join(out)


def tolerant_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add what a text says as strict JSON: itself if it is JSON, else its first object or array, repaired; else null.

    Only texts that Spark can't parse go to Python.
    """

    @F.pandas_udf("string")
    def mended(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([None if v is None else repaired(v) for v in x], dtype="object")

    whole = F.try_parse_json(text).isNotNull() & F.col(text).rlike(r"^\s*[{\[]")
    told = df.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    told = told.withColumn("_mended", mended(F.when(~F.col("_whole"), F.col(text))))
    return told.withColumn(out, F.when(F.col("_whole"), F.trim(text)).otherwise(F.col("_mended"))).drop("_whole", "_mended")


def field(x: Column, name: str) -> Column:
    return F.get_json_object(x, f"$.{name}")
