"""Queues, count windows and log tails as streams with state, and what they come to as batches.

The state of a key is what the queue holds and its counters, so it stays as small as the queue's
capacity. Rows of a micro-batch are taken in the order of their sequence numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.sources import folders


def feed(rows: DataFrame, order: str, path: str, parts: int = 3) -> None:
    """Rows as files that arrive one after the other, in the order of a number."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        rows.coalesce(1).write.mode("append").parquet(path)
        return
    step = (high - low) // parts + 1
    for k in range(parts):
        rows.where(F.col(order).between(low + k * step, low + (k + 1) * step - 1)).coalesce(1).write.mode("append").parquet(path)


def arriving(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The files of a folder as a stream, a few in each micro-batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, kind: str, *, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder; a restart goes on where the checkpoint stands."""
    spark = stream.sparkSession
    path = folders.fresh_path(spark, kind)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def queue(ops: DataFrame, key: str, *, capacity: int, most_stale: int | None = None) -> DataFrame:
    """A bounded queue a key. ops: key, seq, op (put, get or sync), sample.

    A put into a full queue drops the oldest sample and is told so (accepted is false); a get takes the oldest, or
    null from an empty queue; a sync is a new version of the parameters, from which staleness is counted.
    Out comes a row an op: seq, op, sample (put or got), accepted, size, produced, consumed, dropped, and
    paused: the queue is full, or as many samples as `most_stale` were put since the last sync.
    """
    schema = "key bigint, seq bigint, op string, sample bigint, accepted boolean, size bigint, produced bigint, consumed bigint, dropped bigint, paused boolean"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, produced, consumed, dropped, stale = state.get if state.exists else ([], 0, 0, 0, 0)
        held = list(held)
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, op, sample in zip(rows["seq"].tolist(), rows["op"].tolist(), rows["sample"].tolist(), strict=True):
            accepted, said = True, None
            if op == "put":
                if accepted := len(held) < capacity:
                    pass
                else:
                    held.pop(0)
                    dropped += 1
                held.append(int(sample))
                produced, stale, said = produced + 1, stale + 1, int(sample)
            elif op == "get":
                if accepted := bool(held):
                    said = held.pop(0)
                    consumed += 1
            else:
                stale = 0
            out.append((k[0], seq, op, said, accepted, len(held), produced, consumed, dropped, len(held) >= capacity or (most_stale is not None and stale >= most_stale)))
        state.update((held, produced, consumed, dropped, stale))
        made = pd.DataFrame(out, columns=["key", "seq", "op", "sample", "accepted", "size", "produced", "consumed", "dropped", "paused"])
        yield made.astype({"sample": "Int64"})

    rows = ops.select(F.col(key).cast("long").alias("key"), "seq", "op", "sample")
    return rows.groupBy("key").applyInPandasWithState(run, schema, "held array<bigint>, produced bigint, consumed bigint, dropped bigint, stale bigint", "append", GroupStateTimeout.NoTimeout)


def count_windows(rows: DataFrame, key: str, seq: str, value: str, n: int) -> DataFrame:
    """Batches of n rows a key, as soon as they are full: key, batch, n, first, last, total. What remains waits in the state."""
    schema = "key string, batch bigint, n bigint, first bigint, last bigint, total double"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, seqs, values = state.get if state.exists else (0, [], [])
        rows = pd.concat(list(parts)).sort_values("seq")
        seqs, values = [*seqs, *rows["seq"].tolist()], [*values, *rows["value"].tolist()]
        out, full = [], len(seqs) // n * n
        for at in range(0, full, n):
            out.append((k[0], batch + at // n, n, seqs[at], seqs[at + n - 1], float(sum(values[at : at + n]))))
        state.update((batch + full // n, seqs[full:], values[full:]))
        if out:
            yield pd.DataFrame(out, columns=["key", "batch", "n", "first", "last", "total"])

    own = rows.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("double").alias("value"))
    return own.groupBy("key").applyInPandasWithState(run, schema, "batch bigint, seqs array<bigint>, items array<double>", "append", GroupStateTimeout.NoTimeout)


def log_steps(lines: DataFrame, watched: list[int], metrics: list[str], *, crash: str = r"(?i)(Traceback|CUDA out of memory|Error:)") -> DataFrame:
    """Metric dumps of a log, one row a run and watched step, and crashes as step -1. lines: run, value. Repeated dumps come out once."""
    step = F.regexp_extract("value", r"\bstep:(\d+)\b", 1).try_cast("long")
    number = lambda m: F.regexp_extract("value", rf"(?:^|\s){m}:(-?[0-9.]+(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    crashed = F.col("value").rlike(crash)
    rows = lines.select("run", F.when(crashed, F.lit(-1)).otherwise(step).alias("step"), *[number(m).alias(m) for m in metrics])
    return rows.where(F.col("step").isin(-1, *watched)).dropDuplicates(["run", "step"])


def grown(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """A dataset that grows by what a generator makes of each micro-batch; a batch that is repeated replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulated(rows: DataFrame, run: str, order: str, group: str, kept: str, need: int, most: int) -> DataFrame:
    """Generation rounds until enough groups are kept: rounds come in order, those after the one that reaches `need` aren't asked for.

    One row a round that ran: how many groups it kept, how many in all, and `state` (more, done, or failed where
    `most` rounds were not enough). Groups are counted before they are summed over rounds.
    """
    groups = rows.groupBy(run, order, group).agg(F.bool_or(kept).alias("k"))
    rounds = groups.groupBy(run, order).agg(F.sum(F.col("k").cast("long")).alias("kept"))
    w = Window.partitionBy(run).orderBy(order)
    own = rounds.withColumns({"round": F.row_number().over(w), "total": F.sum("kept").over(w)})
    before = own.withColumn("before", F.col("total") - F.col("kept"))
    ran = before.where((F.col("before") < need) & (F.col("round") <= most))
    state = F.when(F.col("total") >= need, "done").when(F.col("round") == most, "failed").otherwise("more")
    return ran.select(run, order, "round", "kept", "total", state.alias("state"))


def feeder_ids(rows: DataFrame, order: str, epochs: int) -> DataFrame:
    """Each row once an epoch under the id sample_{epoch}_{step}; the step counts on over epochs. Rows are ranked by range, not by one task."""
    placed = ranked(rows, order)
    n = placed.agg(F.count("*").alias("_n"))
    each = placed.join(F.broadcast(n), how="cross").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    step = F.col("epoch") * F.col("_n") + F.col("place")
    return each.select(*rows.columns, "epoch", F.format_string("sample_%d_%d", "epoch", step).alias("sample"))


def ranked(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Rows with their place from 0 in the order of a column: sorted by ranges, counted by partition, then numbered within each."""
    spark = rows.sparkSession
    path = folders.fresh_path(spark, "ranked")
    rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = held.groupBy("_part").agg(F.count("*").alias("_c")).withColumn("_first", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).select("_part", "_first")
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_at")
