"""Lists of files in order, capped and drawn, and preference pairs."""

from pyspark.sql import functions as F

from tallyloom.sources import datasets as D


def test_order_of_files(spark, tmp_path):
    spark.range(0, 50).select("id", F.lit("a").alias("t")).repartition(3).write.parquet(f"{tmp_path}/a")
    spark.range(50, 80).select("id").coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.range(0).select("id", F.lit("c").alias("t")).write.parquet(f"{tmp_path}/c")
    files = [f"file://{tmp_path}/{x}" for x in "bca"]
    rows, total = D.concatenated(spark, files, ["id", "t"])
    got = sorted((r.ordinal, r.id, r.t) for r in rows.collect())
    assert total == 80 and [g[0] for g in got] == list(range(80))
    assert [g[1:] for g in got[:30]] == [(i, None) for i in range(50, 80)] and sorted(g[1] for g in got[30:]) == list(range(50))
    first = D.scan(spark, files, ["id"], most=10).collect()
    assert sorted(r.id for r in first) == list(range(50, 60))
    drawn = [sorted(r.id for r in D.scan(spark, files, ["id"], most=10, shuffle=True, seed=s).collect()) for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2] and all(len(x) == 10 for x in drawn)
    assert D.scan(spark, files, ["id", "t"], most=500, length=F.col("id"), longest=9).count() == 10


def test_pairs(spark):
    df = spark.createDataFrame([(1, [1, 2], [3], [4, 5, 6]), (2, None, [], None)], "k int, p array<int>, c array<int>, r array<int>")
    got = {r.k: (r.input_ids, r.attention_mask) for r in D.preference_pairs(df, F.col("p"), F.col("c"), F.col("r"), 5, end_id=9).collect()}
    assert got[1] == ([[1, 2, 3, 9, 0], [1, 2, 4, 5, 6]], [[1, 1, 1, 1, 0], [1, 1, 1, 1, 1]])
    assert got[2] == ([[9, 0, 0, 0, 0]] * 2, [[1, 0, 0, 0, 0]] * 2)
