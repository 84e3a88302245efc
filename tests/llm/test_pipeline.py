"""The pipeline, stage by stage, on a small table with planted cases."""

import corpus_pipeline
from conftest import SMALL


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents", *corpus_pipeline.COLUMNS)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    english = docs.where("lang = 'en' and n_chars > 1500").limit(1).first()
    planted = [
        (900_001, english.text, "en", "p", 1), (900_002, english.text + " more", "en", "p", 1), (900_003, english.text[:900] + " " + item + " " + english.text[900:1400], "en", "p", 1),
        (900_004, "The of and was that with from. " * 3 + english.text[200:700] + " mail me at some.one@mail.example.com or 10.1.2.3", "en", "p", 1), (900_005, "12345 !!", "en", "p", 1),
    ]
    kept, seen = docs.unionByName(spark.createDataFrame(planted, docs.schema)), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL).cache()
        seen[name] = kept
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert 900_005 not in ids["language"] and len(ids["language"]) > 180
    assert not {900_001, 900_002} & ids["near_duplicates"] and english.doc_id in ids["near_duplicates"]
    assert item not in seen["decontamination"].where("doc_id = 900003").first().text
    told = seen["personal_data"].where("doc_id = 900004").first()
    assert "some.one@" not in told.text and "[EMAIL]" in told.text and "[IP]" in told.text and told.n_chars == len(told.text)
    assert ids["packing"] == ids["personal_data"]
    for name in list(seen)[:-1]:
        assert seen[name].columns == list(corpus_pipeline.COLUMNS)
