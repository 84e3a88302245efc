"""Readers and sinks on bad lines, missing files and odd shapes."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scorers as S
from tallyloom.operators import batches as B
from tallyloom.sources import folders
from tallyloom.sources import records as R
from tallyloom.streaming import queues as Q

KIND = "a bigint, b string"


def test_strict_and_tolerant_lines(spark):
    path = folders.fresh_path(spark, "t") + ".jsonl"
    folders.write_text(spark, path, '{"a": 1, "b": "x"}\n\n{"a": 2, broken\n{"a": 3}\n')
    assert R.read_jsonl_tolerant(spark, path, KIND).orderBy("a").collect() == [(1, "x"), (3, None)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        R.read_jsonl(spark, path, KIND).collect()
    assert R.read_jsonl(spark, path + ".none", KIND).collect() == R.read_jsonl_tolerant(spark, path + ".none", KIND).collect() == []


def test_json_shapes(spark):
    base = folders.fresh_path(spark, "t")
    for name, text, want in (
        ("list", '[{"a": 1}, {"a": 2}]', [1, 2]), ("held", '{"n": 2, "examples": [{"a": 1}, {"a": 2}]}', [1, 2]), ("one", '{"a": 5, "b": "x"}', [5]), ("lines", '{"a": 1}\n{"a": 2}\n', [1, 2]),
    ):
        folders.write_text(spark, f"{base}/{name}.json", text)
        assert sorted(r.a for r in R.read_records(spark, f"{base}/{name}.json", KIND).collect()) == want, name
    with pytest.raises(FileNotFoundError):
        R.read_records(spark, f"{base}/none.json", KIND)
    with pytest.raises(FileNotFoundError):
        R.read_first(spark, [f"{base}/none.json", f"{base}/none.parquet"], KIND)
    folders.write_text(spark, f"{base}/x.yaml", "a")
    with pytest.raises(ValueError, match="unknown suffix"):
        R.read_records(spark, f"{base}/x.yaml", KIND)


def test_concatenated_objects(spark):
    path = folders.fresh_path(spark, "t") + ".txt"
    folders.write_text(spark, path, '{"a": 1}{"a": {"x": 2}} \n{bad}{"a": 3}')
    assert [(r.id, r.a) for r in R.read_concatenated(spark, path, "a string").orderBy("id").collect()] == [("reasonif_0000", "1"), ("reasonif_0001", '{"x":2}'), ("reasonif_0003", "3")]


def test_step_files_and_manifests(spark):
    base = folders.fresh_path(spark, "t")
    R.write_steps(spark.createDataFrame([(2, 1), (10, 2), (10, 3)], "step bigint, a bigint"), base, "step")
    folders.write_text(spark, f"{base}/10x.jsonl", "{}")
    assert [s for s, _ in R.step_files(spark, base)] == [2, 10]
    assert sorted(map(tuple, R.load_run(spark, {"r": base}, "r", "a bigint", steps=[10]).collect())) == [(2, 10), (3, 10)]
    with pytest.raises(KeyError):
        R.load_run(spark, {"r": base}, "s", "a bigint")
    assert R.load_run(spark, {"r": base + "none"}, "r", "a bigint").collect() == []
    before = spark.createDataFrame(R.manifest(spark, f"{base}/*.jsonl").collect())
    folders.write_text(spark, f"{base}/10x.jsonl", "{ }")
    folders.write_text(spark, f"{base}/11.jsonl", "{}")
    assert sorted(map(tuple, R.manifest_diff(before, R.manifest(spark, f"{base}/*.jsonl")).collect())) == [("10x.jsonl", "changed"), ("11.jsonl", "extra")]
    assert R.dump_generations({"x": [1, 2], "y": [1]}, 2, spark, base, 3) == 2


def test_resumed_stream_adds_nothing_twice(spark):
    base = folders.fresh_path(spark, "t")
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "i bigint, k bigint")
    Q.feed(rows, "i", f"{base}/in")
    for _ in range(2):
        Q.grown(Q.arriving(spark, f"{base}/in", rows), f"{base}/out", f"{base}/checkpoint", lambda b: b.where("k = 1"))
    assert spark.read.parquet(f"{base}/out").count() == 10


def test_batches():
    """Items go to parts as they come; an item over the budget is an error; the number of batches follows from the tokens."""
    assert B.least_loaded([5, 4, 3, 3, 3], 2) == [[0, 3], [1, 2, 4]]
    parts = B.least_loaded([9, 1, 1, 1], 2, equal_size=True)
    assert sorted(len(p) for p in parts) == [2, 2]
    with pytest.raises(ValueError, match="evenly"):
        B.least_loaded([1, 2, 3], 2, equal_size=True)
    lengths = [7, 3, 9, 1, 30, 4, 4]
    with pytest.raises(ValueError, match="over the budget"):
        B.budget_batches(lengths, 12)
    cut = B.budget_batches(lengths, 30)
    assert sorted(i for p in cut for i in p) == list(range(7)) and len(cut) == 2


def test_scorers(spark):
    cases = [(r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{a{b{c}d}e} tail", "a{b{c}d}e"), (r"\boxed{open", None), ("none", None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    assert [r.b for r in df.orderBy("i").select(S.last_boxed(F.col("x")).alias("b")).collect()] == [w for _, w in cases]
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("v")).first().v
    assert ask(S.json_block(F.lit('x ```json\n{"a": [1]}\n``` y'))) == '{"a": [1]}' and ask(S.json_block(F.lit("{a"))) is None
    assert ask(S.quoted(F.lit('"A" and "b", "a" "B" "c"'))) == ["A", "b", "c"]
    assert ask(S.first_violation(F.array(*[F.lit(v) for v in (True, True, False)]))) == (2, "late") and ask(S.first_violation(F.array(F.lit(True)))) is None
    with pytest.raises(KeyError):
        S.reward("none", F.lit("x"), F.lit("y"))
    with pytest.raises(ValueError, match="taken"):
        S.register("math")(lambda x, g: x)


def test_a_step_is_written_by_several_tasks(spark):
    """No task gets all rows of a step, and a step's files count as one."""
    base = folders.fresh_path(spark, "t")
    rows = spark.range(0, 400, 1, 4).selectExpr("'r' || id % 2 AS run", "id % 3 AS step", "'p' || id % 5 AS prompt")
    R.write_steps(rows, base, "step", run="run", compression="gzip")
    assert len(folders.listed(spark, f"{base}/r0/1.jsonl/part-*.gz")) == 4
    assert [s for s, _ in R.step_files(spark, f"{base}/r1")] == [0, 1, 2]
    assert R.load_run(spark, {"r": f"{base}/r1"}, "r", "prompt string", steps=[2]).groupBy("step").count().collect() == [(2, 66)]
    files = [p for _, p in R.step_files(spark, f"{base}/r0")]
    assert sorted((r.file, r.rows) for r in R.light_index(spark, files, "none").collect()) == [("0.jsonl", 67), ("1.jsonl", 66), ("2.jsonl", 67)]
    assert sorted((r.file, r.rows, r.unique_prompts) for r in R.full_index(spark, files, "none", "prompt string", "prompt").collect()) == [("0.jsonl", 67, 5), ("1.jsonl", 66, 5), ("2.jsonl", 67, 5)]
