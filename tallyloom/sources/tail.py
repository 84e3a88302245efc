"""Growing text files as a stream: what is known of a file is how many bytes of it were read.

A file that is appended to is read on from there, so nothing is read twice and no
line is cut: a line without its end stays for later.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, line string"
BLOCK, SPLIT = 1 << 16, 32 << 20
# Dumps of validation metrics in training logs, and what tells a crash.
STEP = r"step:(\d+)\s+-\s+"
METRIC = r"val-core/([a-zA-Z0-9_]+)/(acc|score)/(mean@16|best@16/mean|maj@16/mean|worst@16/mean):([-\d.]+)"


@dataclass
class Piece(InputPartition):
    """Bytes of a file from one line's start to another line's end."""

    path: str
    start: int
    stop: int


def listing(folder: str, ending: str, newest: bool) -> list[fs.FileInfo]:
    """The files below a folder by path; or the one changed last."""
    system, base = fs.FileSystem.from_uri(folder)
    found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith(("_", "."))]
    found.sort(key=lambda f: f.path)
    return [max(found, key=lambda f: (f.mtime_ns, f.path))] if newest and found else found


def lines_end(system: fs.FileSystem, path: str, start: int, stop: int) -> int:
    """Where the last whole line between two places ends; start if there is none. Read backwards, block by block."""
    with system.open_input_file(path) as file:
        at = stop
        while at > start:
            low = max(start, at - BLOCK)
            file.seek(low)
            if (k := file.read(at - low).rfind(b"\n")) >= 0:
                return low + k + 1
            at = low
    return start


class Lines:
    """What the batch and the stream share: pieces and their lines."""

    def __init__(self, options: dict):
        self.folder, self.ending = options["path"], options.get("ending", "")
        self.newest = options.get("newest", "false") == "true"

    def pieces(self, system: fs.FileSystem, path: str, start: int, stop: int) -> list[Piece]:
        """About SPLIT bytes each, cut at line ends."""
        out = []
        while start < stop:
            end = stop if stop - start <= SPLIT else lines_end(system, path, start, start + SPLIT) or stop
            if end == start:
                end = stop  # a line longer than a piece
            out.append(Piece(path, start, end))
            start = end
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(piece.path) as file:
            file.seek(piece.start)
            data = file.read(piece.stop - piece.start)
        offsets, lines, at = [], [], 0
        for raw in data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]:
            offsets.append(piece.start + at)
            lines.append(raw.rstrip(b"\r").decode("utf-8", "replace"))
            at += len(raw) + 1
        for k in range(0, len(lines), 8192):
            part = lines[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([piece.path] * len(part)), pa.array(offsets[k : k + 8192], pa.int64()), pa.array(part, pa.string())], names=["path", "offset", "line"])


class TailStream(DataSourceStreamReader, Lines):
    def __init__(self, options: dict):
        Lines.__init__(self, options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far each file has whole lines. A file that became shorter was written anew and is read from its start."""
        system, _ = fs.FileSystem.from_uri(self.folder)
        out = dict(self.known)
        for f in listing(self.folder, self.ending, self.newest):
            was = out.get(f.path, 0)
            out[f.path] = lines_end(system, f.path, was if f.size >= was else 0, f.size)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = {**end, **self.known} if not self.known else self.known
        system, _ = fs.FileSystem.from_uri(self.folder)
        return [p for path, stop in sorted(end.items()) for p in self.pieces(system, path, start.get(path, 0) if start.get(path, 0) <= stop else 0, stop)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Lines.read(self, partition)


class TailBatch(DataSourceReader, Lines):
    def __init__(self, options: dict):
        Lines.__init__(self, options)

    def partitions(self) -> list[Piece]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        return [p for f in listing(self.folder, self.ending, self.newest) for p in self.pieces(system, f.path, 0, f.size)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Lines.read(self, partition) if partition.path else iter(())


class LogTail(DataSource):
    """format("log_tail"): path (a folder as URI), ending (of file names), newest (true: only the file changed last)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TailBatch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TailStream(self.options)


def tail(spark: SparkSession, folder: str, *, stream: bool = True, ending: str = "", newest: bool = False) -> DataFrame:
    """Lines with their file and the byte at which they start. An absent or empty folder gives none."""
    spark.dataSource.register(LogTail)
    reader = (spark.readStream if stream else spark.read).format("log_tail").option("path", folder).option("ending", ending).option("newest", str(newest).lower())
    return reader.load()


def metric_dumps(lines: DataFrame, run: Column, watched: list[int]) -> DataFrame:
    """run, step, dataset, metric and value of the watched steps' dumps; the first dump of a run and step that comes counts.

    Names are as acc_mean@16, acc_best@16; numbers that can't be read are left out. As a stream its state is one key
    a run, watched step, dataset and metric.
    """
    step = F.regexp_extract("line", STEP, 1).try_cast("long")
    found = F.expr(f"regexp_extract_all(line, r'{METRIC}', 0)")
    part = lambda k: F.regexp_extract("one", METRIC, k)
    dumps = lines.where(F.col("line").contains("step:") & F.col("line").contains(" - ")).select(run.alias("run"), step.alias("step"), F.explode(found).alias("one")).where(F.col("step").isin(watched))
    named = dumps.select("run", "step", part(1).alias("dataset"), F.concat(part(2), F.lit("_"), F.regexp_replace(part(3), "/mean$", "")).alias("metric"), part(4).try_cast("double").alias("value"))
    return named.where("value IS NOT NULL").dropDuplicates(["run", "step", "dataset", "metric"])


def crashes(lines: DataFrame, run: Column, patterns: list[str]) -> DataFrame:
    """run, offset and the first 200 characters of each line that holds a pattern; a line is known by its file and place."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("line").contains(p)
    return lines.where(hit).select(run.alias("run"), "path", "offset", F.substring("line", 1, 200).alias("line"))
