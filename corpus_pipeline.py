"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept; run()
writes what a stage returns to the shared folder as Parquet and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard, langid, packing, pii
from tallyloom.llm.common import fresh_path, set_aside, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin stay; lang becomes what was told.

    A null or empty text, or one without a letter, has no language and goes. A null lang teaches nothing. Repeated
    rows fare alike; long texts count whole; no rows give none; other columns stay, whatever their names.
    """
    own, back = set_aside(docs, ("lang_pred", "score", "rejected"))
    told = langid.identify(own, langid.fit(own)).where(~F.col("rejected"))
    return told.withColumn("lang", F.col("lang_pred")).select(*own.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (a null id comes last).

    Rows without words are no copies of anything and all stay; of equal rows one stays. Long texts count whole; no
    rows give none; other columns stay.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go.

    Null and empty texts and those without a hit stay as they are. Repeated rows fare alike; no rows, or no
    benchmark, change nothing; other columns stay.
    """
    held = decontaminate.automata(table(spark, sf_dir, "benchmark", "item_id", "text"))
    return counted(decontaminate.remove_spans(docs, held)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind in brackets.

    Every row stays; a null text stays null. Repeated rows fare alike; other columns stay.
    """
    return counted(pii.redact(docs, pii.fit(docs))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens.

    A null or empty text is one piece of the end id alone. Repeated rows have pieces each; no rows, no sequences.
    """
    cut = packing.pieces(docs.select("doc_id", "text"), packing.tokenizer_path())
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]

#: No stage can be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
