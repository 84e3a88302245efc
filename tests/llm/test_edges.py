"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard, langid, lm, mincut, packing, pii, quality, secrets, warc

LONG = "long words here and there " * 20_000
ROWS = [(1, None, None, None, 9), (None, "a b c d e f g", "en", "s", 9), (2, "", "en", "s", 9), (3, "same text of some seven words here", "en", "s", 9), (3, "same text of some seven words here", "en", "s", 9), (4, LONG, "fr", "s", 9), (5, " \n\t ", "fr", None, 9)]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(params=["rows", "none"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def by_place(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_packing(docs):
    cut = packing.pieces(docs, packing.tokenizer_path())
    got = packing.pack(cut).collect()
    assert "score" in cut.columns
    assert sum(r.piece == 0 for r in got) == docs.count()
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert all(r.length == 1 for r in got if r.doc_id in (1, 2, 5))


def test_quality(docs):
    got = quality.judge(quality.text_counts(docs), ["lang", "source"]).collect()
    assert len(got) == docs.count()
    assert all(not r.kept for r in got if r.n_words < 50)


def test_language_model(docs):
    got = lm.score(docs, lm.count(docs)).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 5))
    assert all(isinstance(r.score, float) for r in got)


def test_jaccard(docs):
    got = by_place(jaccard.jaccard_components(docs).collect())
    assert len(got) == docs.count()
    for r in got:
        assert r.component_id == r.doc_id
        assert r.n_shingles == {None: 3, 1: 0, 2: 0, 3: 3, 4: 5, 5: 0}[r.doc_id]
    kept = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == ([0, 1, 2, 3, 4, 5] if got else [])


def test_columns_of_clashing_names_stay(spark):
    import corpus_pipeline

    names = ["hits", "items", "n_words", "n_hit", "longest_match", "lang_pred", "score", "rejected", "n_shingles", "component_id", "base_spans", "added_spans", "_row"]
    rows = [(i, ("some words that stand here and there " + "and so on ") * 5, "en", "s", 1, *[f"own {n}" for n in names]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns, name
        assert all(r[n] == f"own {n}" for r in got.collect() for n in names), name


def test_keep_one_tells_rows_apart(spark):
    near = [" ".join(f"w{k}" for k in range(60)) + f" {end}" for end in "xyz"]
    rows = [(None, "one clean text of its own here"), (None, "another clean text that stands alone"), (None, None), (None, None), (7, near[1]), (3, near[0]), (7, "not a copy of anything else at all"), (None, near[2]), (None, "null ids that hold equal texts"), (None, "null ids that hold equal texts")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, kept)) == sorted(f"Row(doc_id={k!r}, text={t!r})" for k, t in [*rows[:4], rows[5], rows[6], rows[8]])


def test_pii(docs):
    got = pii.find_pii(docs, pii.fit(docs)).collect()
    assert len(got) == docs.count() and all(r.base_spans == [] and r.added_spans == [] for r in got)


def test_decontamination(docs, spark):
    bench = spark.createDataFrame([(1, "some seven words"), (2, None), (3, ""), (4, "some seven words")], "item_id long, text string")
    for chunk in (1 << 20, 1):
        held = decontaminate.automata(bench, chunk_bytes=chunk)
        got = decontaminate.mark_contamination(docs, held).collect()
        assert len(got) == docs.count()
        assert all((r.n_hit, r["items"]) == ((3, ["1", "4"]) if r.doc_id == 3 else (0, [])) for r in got)
    kept = decontaminate.remove_spans(docs, held)
    assert all(r.text == "same text of  here" for r in kept.where("doc_id = 3").collect())
    assert decontaminate.mark_contamination(docs, decontaminate.automata(bench.limit(0))).where("n_hit > 0").count() == 0


def test_secrets(docs):
    got = secrets.find_secrets(docs).collect()
    assert len(got) == docs.count() and all(r.base_spans == [] for r in got)


def test_language(docs):
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    assert all(r.lang_pred == "und" and r.rejected for r in got if r.doc_id in (1, 2, 5))
    assert all(0 <= r.score <= 1 for r in got)


def test_warc(docs, spark, tmp_path):
    pages = docs.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "score")
    for compress in (False, True):
        path = f"file://{tmp_path}/{compress}"
        warc.write_archives(pages, path, compress=compress)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == pages.count()
        for r in got:
            if r.page_id in ("1", "2", "4", None):
                assert r.record_type == ("revisit" if r.page_id == "2" else "response")
            if r.record_type == "response":
                assert warc.digest_of(r.payload) == r.payload_digest and len(r.payload) == r.payload_bytes


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    manifest = warc.write_archives(pages, path, max_file_bytes=1000)
    one = manifest.first().file
    with open(one, "rb") as f, open(one.replace("part-", "part-9"), "wb") as other:
        other.write(f.read())
    got = warc.read_archives(spark, path).collect()
    assert sorted(int(r.page_id) for r in got) == list(range(20))
    assert warc.read_archives(spark, f"file://{tmp_path}/none").collect() == []


def test_html(docs):
    pages = docs.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "score")
    got = mincut.extract(pages, mincut.fit(pages)).collect()
    assert len(got) == pages.count() and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2, 5))


def test_digest_of_nothing():
    assert hashlib.sha256(pii.joined([]).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_secrets_of_a_text_full_of_them(spark):
    """Twenty thousand matches in one text, placed in time that doesn't grow with their square."""
    text = " ".join(f"{i:024x}" for i in range(20_000)) + " token=abcdef1 " * 3
    df = spark.createDataFrame([(1, text), (2, "é " + text)], "doc_id long, text string")
    got = {r.doc_id: r.base_spans for r in secrets.find_secrets(df).collect()}
    for k, shift in ((1, 0), (2, 2)):
        spans = sorted((s.start, s.stop) for s in got[k] if s.kind == "hex")
        assert spans == [(shift + 25 * i, shift + 25 * i + 24) for i in range(20_000)]
        assert sum(s.kind == "assign" for s in got[k]) == 3


def test_typed_strings_of_whole_texts(spark):
    """All of a text is typed: each block of its letters gives one string of every class, wherever it stands."""
    text = "the quick brown fox jumps over 12 lazy dogs and ab3cd runs " * 400
    letters = len("".join(w for w in text.split() if not any(c.isdigit() for c in w)))
    own = secrets.typed_strings(spark.createDataFrame([], "text string"), "text").count()
    got = secrets.typed_strings(spark.createDataFrame([(text,), (None,), ("",)], "text string"), "text").count() - own
    assert 0 <= got - letters // secrets.BLOCK * len(secrets.SIZES) < len(secrets.SIZES) and letters > 10_000


def test_evidence_works_each_part_out_once(spark):
    row = spark.range(1).select(secrets.evidence(F.lit("0123456789abcdef0123"), F.lit("0123456789abcdef"), F.lit(16), F.array(*[F.lit(x) for x in (6.0, 0.0, 10.0, 0.0)])).alias("e"))
    plan = row._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_distinct(") == 1 and plan.count("regexp_replace(") == 0 and row.first().e > 0
