"""What the text operators share: reading tables, whole-row Arrow maps, shared folders."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word of the contracts: no blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; only these are read. Arrow batches are kept small, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI: spark.checkpoint.dir, or one of our own where the master is this machine."""
    if given := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return given if "://" in given or given.startswith("file:") else f"file://{given}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallyloom-"))
    return f"file://{_own[0]}"


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The same rows as a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """The rows with their places 1, 2, 3... in that order, and how many they are.

    Rows are dealt by ranges of the order and stored in it, so no task sees more than its range and places are
    the same however often they are read. Equal rows share a range, in some fixed order. The driver
    sees one count a range.
    """
    place = F.monotonically_increasing_id()
    held = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_numbered", place), "numbered")
    counts = sorted((r.part, r.n) for r in held.groupBy(F.shiftright("_numbered", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    joined = held.join(starts, F.shiftright("_numbered", 33) == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + F.col("_numbered").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_numbered", "_part", "_before"), total


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remembered(kind: str, make: Callable):
    """What a Python worker keeps from task to task: one thing at a time, so that workers stay small."""
    held = holder().__dict__.setdefault("held", {})
    if kind not in held:
        forget()
        held[kind] = make()
    return held[kind]


def forget() -> None:
    """Let go of what the worker remembers, and give freed memory back to the system: workers outlive their tasks."""
    holder().__dict__.get("held", {}).clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this system
        pass


def holder():
    """A module of our own that lives as long as the Python worker, also where this one came by value."""
    return sys.modules.setdefault("_tallyloom_worker", types.ModuleType("_tallyloom_worker"))


def tidy(run: Callable) -> Callable:
    """The map, with memory given back before and after: workers that stay idle keep nothing."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        forget()

    return wrapped


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def apart(df: DataFrame, names: list[str]) -> list[str]:
    """The columns that keep their place beside new ones of these names; a clashing one is replaced."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def drawn(rows: DataFrame, text: str, n: int, *, by: str | None = None, chars: int = 1 << 16, seed: int = 0) -> list:
    """At most n (group, number, text) rows, or n for each value of `by`: those whose text has the smallest hashes, so the same ones at each run.

    The bound is exact, whatever keys or texts repeat: a first pass counts, a second takes a slight surplus by
    rate and keeps the n smallest. Of a text over `chars` long a stretch of that length at a hashed place is drawn.
    Rows without text aren't drawn. What reaches the driver is at most n x chars characters a group.
    """
    group = F.col(by) if by else F.lit("")
    h = F.xxhash64(F.col(text), F.lit(seed))
    rows = rows.where(F.col(text).isNotNull() & group.isNotNull() & (F.length(text) > 0)).select(group.alias("g"), h.alias("h"), F.col(text).alias("t"))
    # equal texts hash alike: they are counted once, so that copies neither crowd a sample nor pass its bound
    distinct = rows.groupBy("g").agg(F.approx_count_distinct("h", 0.02).alias("c"))
    rate = F.least(F.lit(1.0), F.lit(1.5 * n + 50) / F.col("c"))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - chars, F.lit(0)) + 1).cast("int") + 1
    near = rows.join(F.broadcast(distinct), "g").where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))
    once = near.select("g", "h", F.substring(F.col("t"), place, F.lit(chars)).alias("t")).groupBy("g", "h").agg(F.first("t").alias("t"))
    first = once.withColumn("_i", F.row_number().over(Window.partitionBy("g").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("_i") <= n)
    return sorted(first.select("g", "h", "t").collect(), key=lambda r: (r.g, r.h % (1 << 30), r.h))


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns of these names under others, and what renames them back."""
    held = {c: f"_aside_{c}" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(held), {v: k for k, v in held.items()}


def arrow_map(
    df: DataFrame,
    fields: list[tuple[str, str]],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    *,
    drop: tuple[str, ...] = (),
    rows: int = 1024,
    remember: bool = False,
) -> DataFrame:
    """Add columns computed from slices of at most `rows` rows.

    make() runs once a task; what it returns maps a slice to one list a field.
    All other columns are kept unless dropped; those with clashing names are replaced.
    """
    kept = [c for c in apart(df, [n for n, _ in fields]) if c not in drop]
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([df.schema[c] for c in kept] + new.fields)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = work(part)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new.names])

    return df.mapInArrow(run if remember else tidy(run), schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes, without decoding."""
    c = batch.column(batch.schema.get_field_index(column))
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()
