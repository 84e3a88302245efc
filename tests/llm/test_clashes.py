"""Extra columns whose names clash with what operators add, long texts and ties, for every operator."""

import math

import pytest
import zstandard
from conftest import SMALL
from pyspark.sql import functions as F

from tallyloom.llm import conversations, decontaminate, jaccard, langid, licenses, lm, mincut, packing, pii, quality, resample, secrets, warc

LONG = "a long text of many words and lines.\n" * 8000
ADDED = {
    "pack": ["sequence_id", "piece", "START", "length", "offset", "ids_crc32"], "quality": ["N_Words", "kept", "base_failed", "Symbol_Ratio", "failed_ratios"], "lm": ["n_tokens", "Score", "base_score", "held_out"],
    "jaccard": ["n_shingles", "component_id"], "pii": ["base_spans", "Added_Spans"], "decontaminate": ["n_words", "n_hit", "Items"], "secrets": ["base_spans", "added_spans", "Evidence"], "langid": ["lang_pred", "Score", "rejected"],
    "licenses": ["n_words", "Labels", "detections", "phrases", "score"], "resample": ["rank", "Weight", "score", "n_features", "n_words"], "mincut": ["n_chars"],
}


def run(name, df):
    spark = df.sparkSession
    if name == "pack":
        return packing.pack(packing.pieces(df, packing.tokenizer_path()))
    if name == "quality":
        return quality.judge(quality.text_counts(df), ["lang", "source"])
    if name == "lm":
        return lm.score(df, lm.count(df))
    if name == "jaccard":
        return jaccard.jaccard_components(df)
    if name == "pii":
        return pii.find_pii(df, pii.fit(df))
    if name == "decontaminate":
        return decontaminate.mark_contamination(df, decontaminate.automata(spark.createDataFrame([(1, "many words and lines")], "item_id long, text string")))
    if name == "secrets":
        return secrets.find_secrets(df)
    if name == "langid":
        return langid.identify(df, langid.fit(df))
    if name == "licenses":
        return licenses.find_licenses(df)
    if name == "resample":
        return resample.resample(df, df.select("text"), least_words=1)
    pages = df.withColumnsRenamed({"doc_id": "page_id", "lang": "url", "text": "html"})
    return mincut.extract(pages, mincut.fit(pages))


@pytest.mark.parametrize("name", ADDED)
def test_clashing_columns(spark, name):
    rows = [(1, LONG, "en", "s"), (2, "short text of six words here", "en", "s"), (2, "short text of six words here", "en", "s"), (3, None, None, None)]
    df = spark.createDataFrame([(*r, *["own"] * len(ADDED[name])) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in ADDED[name]))
    got = run(name, df)
    lower = [c.lower() for c in got.columns]
    assert len(lower) == len(set(lower)), got.columns
    out = got.collect()
    assert {r["page_id" if name == "mincut" else "doc_id"] for r in out} == {1, 2, 3} and (name == "pack" or len(out) == 4)


def test_clashing_columns_of_pages_and_turns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", LONG, "own", "own"), (2, "u", LONG, "own", "own")], "page_id long, url string, html string, _first string, payload string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w").orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [("1", "response", None), ("2", "revisit", "1")] and got[0].payload == LONG.encode()
    turns = spark.createDataFrame([(1, 0, "user", LONG, "own", "own"), (1, 1, "assistant", "Yes.", "own", "own")], "conv_id long, turn long, role string, text string, cost string, Gone string")
    assert conversations.repair(conversations.damage(turns)).count() == 1


def test_languages_against_plain_zstandard(spark):
    """Sizes, choices and scores are those of plain calls with the model's dictionaries, texts taken whole."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(F.col("doc_id") % 5 != 0))
    assert len(model.dictionaries) == 4

    def size(data, content, level):
        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(data))

    texts = {r.doc_id: r.text for r in docs.where("doc_id % 7 = 0").collect()}
    assert len(texts) >= 20
    for r in langid.identify(docs.where("doc_id % 7 = 0"), model).collect():
        data = langid.letters(texts[r.doc_id])
        if not data:
            continue
        level = model.short_level if len(data) <= model.short_bytes else model.level
        blocks = [data[i : i + model.block_bytes] for i in range(0, len(data), model.block_bytes)]
        sizes = {g: sum(size(b, c, level) for c in own for b in blocks) / len(own) for g, own in model.dictionaries.items()}
        best = min(sizes.values())
        order = sorted(sizes, key=sizes.get)
        assert sizes[r.lang_pred] == best, (r, sizes)
        assert r.score == pytest.approx(1 / sum(math.exp(-60 * (s - best) / max(sizes.values())) for s in sizes.values()))
        assert r.rejected == ((sizes[order[1]] - best) / max(sizes.values()) < model.margin)


def test_ties_of_languages(spark):
    """Two labels that learnt the same: neither is nearer, the one with more rows is said, and it is rejected."""
    rows = [(i, "the same words in both of them", "aa" if i % 3 else "bb") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.fit(df)).select("lang_pred", "rejected", "score").distinct().collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("aa", True)] and 0 <= got[0].score <= 1


def test_decontamination_by_passes(spark):
    """Many chunks in passes of one automaton each give what one automaton does."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    one = decontaminate.automata(bench.union(bench))
    many = decontaminate.automata(bench, chunk_bytes=4000)
    assert one.count() == 1 and many.count() > 2

    def told(held, **settings):
        got = decontaminate.mark_contamination(docs, held, **settings).collect()
        return {r.doc_id: (r.n_words, r.n_hit, r["items"], r.longest_match, r.hits) for r in got}

    whole = told(one)
    assert told(many, pass_bytes=1) == whole == told(many) and any(v[1] for v in whole.values())
