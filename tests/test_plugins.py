"""Growing files, generators as table functions, and orders by bijection."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import generators, permute
from tallyloom.sources import tail


def run_once(spark, folder, base, **options):
    lines = tail.tail(spark, f"file://{folder}", **options)
    lines.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted((os.path.basename(r.path), r.offset, r.line) for r in spark.read.schema(tail.SCHEMA).parquet(f"{base}/rows").collect())


def test_log_is_read_on(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"
    a.write_text("one\ntwo\nhal")
    first = run_once(spark, folder, tmp_path / "s")
    assert first == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with a.open("a") as f:
        f.write("f a line\n\nÉnd")
    b.write_bytes(b"x\r\n\xff\n")
    second = run_once(spark, folder, tmp_path / "s")
    assert second == sorted([*first, ("a.log", 8, "half a line"), ("a.log", 20, ""), ("b.log", 0, "x"), ("b.log", 3, "�")])
    assert run_once(spark, folder, tmp_path / "s") == second  # nothing new
    a.write_text("anew\n")
    assert run_once(spark, folder, tmp_path / "s") == sorted([*second, ("a.log", 0, "anew")])


def test_pieces_meet_at_line_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT", 64)
    monkeypatch.setattr(tail, "BLOCK", 16)
    lines = [("y" * (k * 7 % 150)) for k in range(60)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.log").write_text("\n".join(lines) + "\nno end")
    reader = tail.TailStream({"path": f"file://{tmp_path}/l"})
    end = reader.latestOffset()
    pieces = reader.partitions({}, end)
    got = [(o, x) for p in pieces for b in reader.read(p) for o, x in zip(b.column("offset").to_pylist(), b.column("line").to_pylist())]
    assert len(pieces) > 1 and [x for _, x in got] == lines and got == sorted(got)
    batch = tail.TailBatch({"path": f"file://{tmp_path}/l"})
    assert [x for p in batch.partitions() for b in batch.read(p) for x in b.column("line").to_pylist()] == [*lines, "no end"]
    assert reader.partitions(end, end) == []


def test_newest_log_and_empty_folder(spark, tmp_path):
    assert tail.tail(spark, f"file://{tmp_path}/absent", stream=False).collect() == []
    (tmp_path / "old.log").write_text("old\n")
    (tmp_path / "new.log").write_text("new\n")
    (tmp_path / "other.txt").write_text("other\n")
    os.utime(tmp_path / "old.log", (1, 1))
    got = tail.tail(spark, f"file://{tmp_path}", stream=False, ending=".log", newest=True).collect()
    assert [r.line for r in got] == ["new"]


def test_dumps(spark):
    rows = [("/a", 0, "x step:25 - val-core/aime24/acc/mean@16:0.5 - val-core/aime24/acc/best@16/mean:0.75 - val-core/b/score/mean@16:-1.5"), ("/a", 9, "step:25 - val-core/aime24/acc/mean@16:0.5"), ("/a", 10, "step:26 - val-core/aime24/acc/mean@16:0.9"), ("/a", 11, "step:50 - val-core/c/acc/maj@16/mean:-"), ("/a", 12, None), ("/b", 0, "step:25 - val-core/aime24/acc/worst@16/mean:0"), ("/b", 1, "RayTaskError here")]
    df = spark.createDataFrame(rows, tail.SCHEMA)
    got = tail.metric_dumps(df, F.col("path"), [25, 50]).collect()
    assert sorted(map(tuple, got)) == [("/a", 25, "aime24", "acc_best@16", 0.75), ("/a", 25, "aime24", "acc_mean@16", 0.5), ("/a", 25, "b", "score_mean@16", -1.5), ("/b", 25, "aime24", "acc_worst@16", 0.0)]
    assert [r.line for r in tail.crashes(df, F.col("path"), ["RayTaskError"]).collect()] == ["RayTaskError here"]


def test_generators(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "n"), (2, 5, None)], "g int, i int, t string")
    generators.register(spark, "again", generators.FirstAgain, partition=["g"], order=["i"])
    got = generators.generate(df, "again")
    assert got.columns == ["g", "i", "t", "generated"]
    assert sorted(map(repr, map(tuple, got.where("generated").collect()))) == sorted(map(repr, [(1, 1, "a", True), (None, 1, "n", True), (2, 5, None, True)]))
    assert got.where("NOT generated").count() == 4 and generators.generate(df.limit(0), "again").count() == 0
    with pytest.raises(Exception, match="needs the columns"):
        generators.generate(df.drop("i"), "again").collect()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_places(spark, n):
    rows = spark.range(n).select("id", *[permute.place(F.col("id"), n, F.lit(k)).alias(f"p{k}") for k in (0, 1, -5)]).collect()
    for k in (0, 1, -5):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(n))
    if n >= 100:
        assert [r.p0 for r in rows] != [r.p1 for r in rows]
        assert abs(sum(r.id * r.p0 for r in rows) / n - ((n - 1) / 2) ** 2) < n * n / 12  # hardly correlated
    assert spark.range(1).select(permute.place(F.lit(n), n, F.lit(0)).alias("p")).first().p is None


def test_epochs_do_not_shuffle(spark):
    df = permute.epochs(spark.range(100), "id", 100, 10, 3, 1)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.groupBy("epoch", "batch").count().where("count = 10").count() == 30
    with pytest.raises(ValueError, match="multiple"):
        permute.epochs(spark.range(101), "id", 101, 10, 3, 1)
