"""Checker queries against their SQL on odd texts: none, empty and blank ones, white space, marks and letters outside ASCII."""

import random

import duckdb
import pytest

from tallyloom import catalog

PARTS = (
    "the", "The ", "the ", "THE", "_the_", "__", "and", "license", "lİcense", "LICENSE", "K", "toKen", "stupid", "an", "AN", "BY-NC", "of the", "e", "É", "é", "ñ", "ς", "Σ", "ǅ", "ʰ", "中", "²", "Ⅷ", "AB", "A", "_", "'", "-", "- x", "* y", "*", "**",
    "***", "* * *", "*\x0b**", "*a*", "[", "]", "[x]", "<<", ">>", "<<\n>>", '"', ".", ",", "，", "!", "a-b", "My answer is yes.", " ", "  ", "\t", "\n", "\n\n", "\n \n", "\n\xa0\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "　", "​", "‍", "﻿",
)


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    fixed = [None, "", " ", "\n", "\xa0", "　 \n", "the ", "The ", " The ", "\x0bThe end.", "end.\xa0", "end.\x0b", "My answer is yes.", '"', ' "a" ', '"a"\x0b', "***", "a *** b", "***...*** the", "_the_", "the_", "__ the", "lİcense", "x \n\n \n y", "a\n\x0b\nb", "a\r- b", "x * y", "thé", "d-e", " ".join(["w"] * 300), " ".join(["é"] * 301), "a-" * 301, "a -" * 301, "AB " * 5, "AB́ " * 5]
    return fixed + list(PARTS) + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    rows = [(k, t, "en", f"s{k % 7}") for k, t in enumerate(odd_texts(1500))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["v01_checkers", "c17_fold", "r08_strict_first"])
def test_odd_texts_as_in_sql(spark, odd, name):
    d, c = odd
    df = catalog.QUERIES[name](spark, d)
    got = sorted(repr(tuple(r[n] for n in sorted(df.columns))) for r in df.collect())
    have = c.execute(catalog.ORACLES[name])
    at = [[x[0] for x in have.description].index(n) for n in sorted(df.columns)]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in have.fetchall())
