"""WARC archives: a writer that runs on the executors and a Python data source that reads them back.

The source plans one partition a file (the writer bounds their size), takes filters on
the record type and on headers, parses the headers of a record first, and seeks
past payloads that a filter or the schema makes needless.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull

from .common import fresh_path, stored, table, tidy

PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
#: Columns by the header that holds them.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest",
    "page_id": "warc-page-id", "refers_to": "warc-refers-to-page-id",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes bigint, payload binary"
MANIFEST = "_manifest"
BROADCAST_ROWS = 200_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: object, url: str | None, payload: bytes, first: object, revisit: bool, date: str) -> bytes:
    """One record; a revisit has the HTTP headers but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"WARC-Refers-To-Page-ID: {first}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, *, key: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Add `_first`: for rows whose payload others share, the smallest key among them.

    Digests are counted before they pass through the shuffle. Those that occur more than
    once are a small table, broadcast if it has at most BROADCAST_ROWS rows; if it has
    more, the pages themselves pass through a shuffle join, whose frequent keys Spark splits.
    A null payload counts as empty; a table without rows gives none; other columns stay.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    with_digest = pages.withColumn("_digest", F.when(F.octet_length(payload) >= least_bytes, F.sha1(payload)))
    shared = with_digest.where("_digest is not null").groupBy("_digest").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    shared = stored(shared, "shared-payloads")
    small = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return with_digest.join(F.broadcast(shared) if small else shared, "_digest", "left").drop("_digest")


def write_archives(
    pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, max_file_bytes: int = 128 << 20, date: str = "2024-01-01T00:00:00Z", compress: bool = False
) -> DataFrame:
    """Write one record a row under `path` (a URI all executors reach); returns file, records, bytes.

    Of equal payloads of at least `least_bytes` the one with the smallest key is the
    response and the others revisit it; rows that have that same key are all
    responses. A null html is an empty payload; a null key or url leaves its header
    out, and a null key comes after all others. A task writes files under names of
    its attempt. What was written stands in the table `_manifest` beside the files, which
    readers go by: what a lost attempt left behind, however it cut its files, isn't read.
    """
    marked = mark_revisits(pages.select(key, url, html), key=key, html=html, least_bytes=least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        out, number, size, count, made = None, 0, 0, 0, []

        def close():
            nonlocal out, size, count
            if out is not None:
                out.close()
                store.move(temporary, final)
                made.append((final, count, size))
                out, size, count = None, 0, 0

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (key, url, html, "_first")]
            for page, u, h, first in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None:
                    final = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId():08d}-{number:04d}.warc" + ".gz" * compress
                    temporary = f"{top}/_{task.taskAttemptId()}-{number}.part"
                    out, number = store.open_output_stream(temporary, compression=None), number + 1
                data = record(page, u, (h or "").encode(), first, first is not None and page != first, date)
                data = gzip.compress(data, 6, mtime=0) if compress else data
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= max_file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    manifest = f"{path.rstrip('/')}/{MANIFEST}"
    marked.mapInArrow(tidy(run), "file string, records bigint, bytes bigint").write.mode("append").parquet(manifest)
    return pages.sparkSession.read.schema("file string, records bigint, bytes bigint").parquet(manifest)


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.uri, self.names = options["path"], [f.name for f in schema.fields]
        self.wanted: dict[str, set[str]] = {}
        if types := options.get("recordtypes"):
            self.wanted["record_type"] = set(types.split(","))

    def pushFilters(self, filters):  # noqa: N802
        """Equality and membership on header columns are ours; all else is left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
                self.wanted[name] = self.wanted.get(name, {f.value}) & {f.value}
            elif name in HEADERS and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.wanted[name] = self.wanted.get(name, set(f.value)) & set(f.value)
            elif name == "record_type" and isinstance(f, IsNotNull):
                pass  # every record has a type
            else:
                yield f

    def partitions(self):
        store, top = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        tables = [i.path for i in found if i.is_file and f"/{MANIFEST}/" in i.path and i.path.endswith(".parquet")]
        named = {n for t in tables for n in pq.read_table(t, columns=["file"], filesystem=store).column("file").to_pylist()}
        return [FilePart(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.path.endswith((".warc", ".warc.gz")) and (not tables or i.path in named)] or [FilePart("")]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        rows, held = [], 0
        with store.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            for row in self.records(stream):
                rows.append(row)
                held += len(row[-1] or b"") if self.names and self.names[-1] == "payload" else 0
                if len(rows) >= 4096 or held >= 16 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(self.names)], names=self.names)

    def records(self, stream):
        """Headers first; the rest of a record is read only if the row is wanted."""
        buffer, end = b"", False

        def more() -> bool:
            nonlocal buffer, end
            data = stream.read(1 << 16)
            end = not data
            buffer += data
            return not end

        def skip(n: int) -> None:
            nonlocal buffer
            if n > len(buffer):
                past = n - len(buffer)
                buffer = b""
                stream.seek(past, 1)
            else:
                buffer = buffer[n:]

        while True:
            while b"\r\n\r\n" not in buffer and more():
                pass
            if not buffer.strip():
                return
            head, found, _ = buffer.partition(b"\r\n\r\n")
            if not found or not head.lstrip().startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            buffer = buffer[len(head) + 4 :]
            headers = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            values = {c: headers.get(h) for c, h in HEADERS.items()}
            if (d := values["payload_digest"]) is not None:
                values["payload_digest"] = d.removeprefix("sha1:")
            if any(values[c] not in v for c, v in self.wanted.items()):
                skip(size + 4)
                continue
            need = {"payload", "payload_bytes"} & set(self.names)
            values["payload"] = values["payload_bytes"] = None
            rest = size
            if need and headers.get("content-type", "").startswith("application/http"):
                while b"\r\n\r\n" not in buffer[:size] and len(buffer) < min(size, 1 << 20) and more():
                    pass
                http, _, _ = buffer[:size].partition(b"\r\n\r\n")
                buffer, rest = buffer[len(http) + 4 :], size - len(http) - 4
                for line in http.split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length":
                        values["payload_bytes"] = int(value)
                if "payload" in need and values["record_type"] == "response":
                    parts = [buffer]
                    while (left := rest - sum(map(len, parts))) > 0 and (data := stream.read(left)):
                        parts.append(data)
                    buffer = b"".join(parts) if len(parts) > 1 else buffer
                    values["payload"] = buffer[:rest]
            skip(rest + 4)
            yield [values[n] for n in self.names]


class WarcSource(DataSource):
    """spark.read.format("warc").load(uri); option recordTypes: a comma-joined list."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records under `path`; with `columns`, only these are parsed and needless payloads are not read.

    Where there is a manifest, only files that it names; an absent or empty folder gives none. A header that a record
    doesn't have is null.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc")
    if columns:
        kinds = {"payload": "binary", "payload_bytes": "bigint"}
        reader = reader.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return reader.load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    columns = ["record_type", "payload_digest", "page_id", "refers_to", "payload_bytes"]
    read = read_archives(spark, path, columns).where(F.col("record_type").isin("response", "revisit"))
    return read.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))
