"""Training datasets that are lists of Parquet files: in order, capped or sampled, without prompts that are too long, and as preference pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.permute import place

ORDINAL = "ordinal"


def concatenated(spark: SparkSession, files: list[str], columns: list[str]) -> tuple[DataFrame, int]:
    """The rows of Parquet files or folders one after the other, with their place in that order, and how many they are.

    A row's place is its file's, by a count of each file, and its own in the file, which the reader knows: nothing is
    sorted or shuffled. Files of a folder go by path. A file that lacks a column has nulls. What reaches the driver is a count a file.
    """
    own, total = [], 0
    for k, file in enumerate(files):
        read = spark.read.parquet(file)
        named = [F.col(c) if c in read.columns else F.lit(None).cast("string").alias(c) for c in columns]
        rows = read.select(*named, F.lit(k).alias("_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
        counts = sorted((r["_path"], r["n"]) for r in rows.groupBy("_path").agg(F.count("*").alias("n")).collect())
        starts = []
        for path, n in counts:
            starts.append((path, total))
            total += n
        begin = spark.createDataFrame(starts, "_path string, _begin long")
        own.append(rows.join(F.broadcast(begin), "_path").withColumn(ORDINAL, F.col("_begin") + F.col("_row")).select(*columns, ORDINAL))
    return reduce(lambda a, b: a.unionByName(b), own), total


def scan(spark: SparkSession, files: list[str], columns: list[str], *, most: int = -1, shuffle: bool = False, seed: int = 0, length: Column | None = None, longest: int | None = None) -> DataFrame:
    """Rows of a dataset with their ordinal: all, the first `most`, or as many drawn by the seed; then without those over a length.

    Drawing gives each row a place by a bijection, so exactly that many are drawn, the same at each run. As rows are
    capped before they are filtered, fewer may be left. A null length is kept.
    """
    rows, total = concatenated(spark, files, columns)
    if 0 < most < total:
        rows = rows.where((place(F.col(ORDINAL), total, F.lit(seed)) if shuffle else F.col(ORDINAL)) < most)
    if length is not None and longest is not None:
        rows = rows.where(F.coalesce(length <= longest, F.lit(True)))
    return rows


def preference_pairs(df: DataFrame, prompt: Column, chosen: Column, rejected: Column, size: int, *, end_id: int | None = None) -> DataFrame:
    """Add input_ids and attention_mask, each of two rows (chosen, rejected) of exactly `size` values: the prompt's ids, the response's, and an end.

    What is longer is cut at its end, what is shorter filled with 0, where the mask is 0. A null list of ids is empty.
    """
    empty = F.array().cast("array<int>")

    def row(response: Column) -> Column:
        tail = [F.array(F.lit(end_id))] if end_id is not None else []
        return F.concat(F.coalesce(prompt, empty), F.coalesce(response, empty), *tail)

    def filled(ids: Column) -> Column:
        return F.concat(F.slice(ids, 1, size), F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(ids), F.lit(0))))

    ids = F.transform(F.array(row(chosen), row(rejected)), filled)
    mask = F.transform(F.array(row(chosen), row(rejected)), lambda x: filled(F.transform(x, lambda _: F.lit(1))))
    return df.withColumns({"input_ids": ids, "attention_mask": mask})
