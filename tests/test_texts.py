"""Text measures against plain Python."""

import time

from pyspark.sql import functions as F

from tallyloom.functions import texts as X


def test_ngram_list_of_long_texts(spark):
    """The pieces of a text are worked out once: by run, 20,000 words take minutes."""
    rows = spark.createDataFrame([(" ".join(f"w{i % 997}" for i in range(20_000)),), ("one",), ("a b c",), ("",)], "x string")
    began = time.time()
    got = rows.select(F.size(X.ngram_list(X.pieces(F.col("x")), 2)).alias("n"), F.element_at(X.ngram_list(X.pieces(F.col("x")), 2), -1).alias("last")).where("n > 0").collect()
    assert sorted((r.n, r["last"]) for r in got) == [(2, "b c"), (19_999, "w58 w59")]
    assert time.time() - began < 30
