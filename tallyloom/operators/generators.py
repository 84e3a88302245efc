"""Generators that make new rows from a dataset, as table functions of any schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Generator:
    """Makes rows for one partition of a table. Override what is needed; a new one is made for each partition."""

    def row(self, row: dict) -> Iterable[dict]:
        """New rows, given the next row of the partition."""
        return ()

    def end(self) -> Iterable[dict]:
        """New rows, once all rows of the partition were given."""
        return ()


class FirstAgain(Generator):
    """Appends the first row of its partition once more."""

    def __init__(self):
        self.first: dict | None = None

    def row(self, row: dict) -> Iterable[dict]:
        self.first = self.first or row
        return ()

    def end(self) -> Iterable[dict]:
        return () if self.first is None else (self.first,)


def register(spark: SparkSession, name: str, make: Callable[[], Generator], *, partition: list[str], order: list[str]) -> None:
    """A generator as the table function `name(TABLE(t))`.

    What comes out has the table's own columns, whatever they are, and `generated`. The function itself asks for the
    table by partition and in order, so Spark deals the rows, and a partition is streamed: a generator
    holds what it wants to remember and nothing else.
    """

    class Made:
        def __init__(self):
            self.generator: Generator | None = None
            self.names: list[str] = []

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            have = [f.name for f in rows.dataType.fields]
            missing = [c for c in (*partition, *order) if c not in have]
            if missing or "generated" in have:
                raise ValueError(f"{name} needs the columns {missing} and none called generated" if missing else f"{name} adds a column called generated")
            schema = T.StructType([*rows.dataType.fields, T.StructField("generated", T.BooleanType())])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(c) for c in partition], orderBy=[OrderingColumn(c) for c in order])

        def eval(self, rows: Row):
            if self.generator is None:
                self.generator, self.names = make(), rows.__fields__
            own = rows.asDict(recursive=False)
            yield (*rows, False)
            for made in self.generator.row(own):
                yield (*(made.get(c) for c in self.names), True)

        def terminate(self):
            if self.generator is not None:
                for made in self.generator.end():
                    yield (*(made.get(c) for c in self.names), True)

    spark.udtf.register(name, F.udtf(Made))


def generate(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table and those that a registered generator makes of them."""
    return df.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{rows}}))", rows=df)
