"""Repairs of JSON, and languages on rows that taught nothing."""

import json
import math

import pytest

from tallyloom.functions import tolerant
from tallyloom.operators import language

REPAIRS = {
    '{"a": 1}': {"a": 1}, "{'a': 'b'}": {"a": "b"}, '{"a": [1, 2,],}': {"a": [1, 2]}, '{"a": "open': {"a": "open"}, '{"a": [1, {"b": 2': {"a": [1, {"b": 2}]}, "say {a: yes, b: TRUE, c: None}": {"a": "yes", "b": True, "c": None},
    "{'a': '''it's\n\"so\"'''}": {"a": "it's\n\"so\""}, '{"a": "x\ny"}': {"a": "x\ny"}, '[1 2 "3"] tail }': [1, 2, "3"], '{"a" 1 "b" 2}': {"a": 1, "b": 2}, '{"a": +1.50, "b": .5, "c": 5., "d": -007}': {"a": 1.5, "b": 0.5, "c": 5.0, "d": -7},
    '{"a": [1, 2}': {"a": [1, 2]}, '{"a":, "b"}': {"a": None, "b": None}, '{,,"a": 1,,}': {"a": 1}, "{": {}, '{"a": "\\u00e9\\n\\q"}': {"a": "é\nq"}, '{"a": {"b": []}} {"c": 1}': {"a": {"b": []}}, '{"a": "\\ud800"}': {"a": "?"}, "{'it': 'don\\'t'}": {"it": "don't"},
    "nothing here": None, "": None, "[" * 500: None, '{"a": 1e5, "b": 1-2}': {"a": 1e5, "b": "1-2"},
}


@pytest.mark.parametrize("text", REPAIRS)
def test_repairs(text):
    got = tolerant.repaired(text)
    assert (None if got is None else json.loads(got)) == REPAIRS[text]


def test_only_broken_texts_are_mended(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{'a': 1,}"), (3, None), (4, "7"), (5, ' {"z": [1]} ')], "id int, t string")
    got = {r.id: r.j for r in tolerant.tolerant_json(df, "t", "j").collect()}
    assert got == {1: '{"a": 1}', 2: '{"a":1}', 3: None, 4: None, 5: '{"z": [1]}'}


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    profile = language.profiles(docs.where("doc_id % 5 <> 0"), "text", "lang")
    got = language.languages(docs, "doc_id", "text", profile).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 5 = 0 AND lang IS NOT NULL").collect()
    assert sum(r.language == r.lang for r in got) >= 0.95 * len(got) > 0


def test_texts_without_letters(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !", None), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (6, "the dog", None)], "id int, t string, lang string")
    got = {r.id: (r.language, r.n) for r in language.languages(df, "id", "t", language.profiles(df, "t", "lang")).collect()}
    assert got[1] == got[2] == got[3] == (None, 0) and [got[k][0] for k in (4, 5, 6)] == ["en", "fr", "en"]
    assert all(r.language is None for r in language.languages(df, "id", "t", language.profiles(df.limit(0), "t", "lang")).collect())


def test_languages_where_texts_are(spark, monkeypatch):
    """Nothing is shuffled by text and trigram, and bundles of any size give the same, also with signs beyond two bytes."""
    df = spark.createDataFrame([(1, "the cat 𝒜𝒷𝒸 and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "à 12", None), (5, "the dog " * 50, None)], "id int, t string, lang string")
    profile = language.profiles(df, "t", "lang")
    assert profile.where("gram = '𝒜𝒷𝒸'").count() == 1 and profile.where("gram = 'the'").first().weight == pytest.approx(math.log(2.5 / 0.5))
    rows = language.languages(df, "id", "t", profile)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, rows.collect()))
    assert whole[0] == (1, "en", 23) and whole[2] == (3, None, 0) and whole[3][2] == 1 and whole[4][:2] == (5, "en")
    monkeypatch.setattr(language, "SIGNS", 1)
    monkeypatch.setattr(language, "SIDE", 1)
    assert sorted(map(tuple, language.languages(df, "id", "t", language.profiles(df, "t", "lang")).collect())) == whole
