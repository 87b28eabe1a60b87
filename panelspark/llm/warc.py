"""WARC archives: a writer on Spark's own file commit, and a Python data source that reads them back.

Writing: records are built by column functions and written as Spark text files (line ends ``\\r\\n``), so a lost
executor leaves no half archives and any file system of Spark's serves.  Equal payloads (length and SHA-1) are found
by one pre-aggregated grouping of digests; only groups of two or more are joined back (broadcast if counted few), to make revisit records.

Reading: whole files are dealt to partitions of about ``split_bytes``.  Equality, IN and null conditions on header
columns are pushed down (as in SQL, null equals nothing and passes IS NULL and <=> null only); a record's headers are parsed first, and payloads that no one wants (by condition, or
because the schema asked for has no ``payload``) are skipped by seeking.

Archives whose names end in .gz (a gzip member a record, or one for all) are read as well; of those, payloads that no one
wants are unpacked but not kept.

Defined results: null html is the empty payload; null urls and ids have no header and come back as null; rows with
equal id and payload are all the response.  Damaged archives raise ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from .shared import keep, small

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_HEADERS = {"page_id": "x-page-id", "url": "warc-target-uri", "record_type": "warc-type", "payload_bytes": "x-payload-length", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page"}
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, forty bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """A record per page.  Of equal payloads of at least ``min_bytes``, that with the smallest id is a response and the
    others revisit it."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", "").alias("url"), html.alias("html"))
    base = base.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html")))
    groups = base.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = base.join(small(keep(groups)), ["digest", "bytes"], "left").withColumn("revisit", F.coalesce(F.col("first") != F.col("id"), F.lit(False)))
    named = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(c.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    only = lambda c: F.when(F.col("revisit"), c)
    record = F.concat_ws(
        "",
        F.lit(f"WARC/1.1{_END}"),
        head("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        head("WARC-Record-ID", F.coalesce(named(F.col("id")), named(F.lit("")))), head("WARC-Date", F.lit(date)), head("WARC-Target-URI", F.col("url")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), head("X-Payload-Length", F.col("bytes")), head("X-Page-Id", F.col("id")),
        only(head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        only(head("WARC-Refers-To", named(F.col("first")))), only(head("X-Refers-To-Page", F.col("first"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}"), head("Content-Length", F.octet_length(body)), F.lit(_END), body, F.lit(_END),
    )
    rows.select(record.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Archives(InputPartition):
    """The files of one task."""

    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, split_bytes: int, verify: bool):
        self.path, self.fields, self.split_bytes, self.verify = path, [f.name for f in schema.fields], split_bytes, verify
        self.arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema.fields])
        self.tests: list[tuple[str, frozenset | None, bool]] = []  # column, values that pass (None: all), whether null passes

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in _HEADERS:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((name, None, False))
            elif isinstance(f, IsNull) or isinstance(f, EqualNullSafe) and f.value is None:
                self.tests.append((name, frozenset(), True))
            else:  # a comparison with null is never true
                values = f.value if isinstance(f, In) else [f.value]
                self.tests.append((name, frozenset(v for v in values if v is not None), False))

    def partitions(self) -> list[Archives]:
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True))
        out, total = [Archives([])], 0
        for info in sorted((i for i in found if i.is_file and i.size and not i.base_name.startswith(("_", "."))), key=lambda i: i.path):
            if out[-1].paths and total + info.size > self.split_bytes:
                out.append(Archives([]))
                total = 0
            out[-1].paths.append(info.path)
            total += info.size
        return out

    def _wanted(self, row: dict) -> bool:
        return all(null if row[name] is None else values is None or row[name] in values for name, values, null in self.tests)

    def _records(self, stream) -> Iterator[dict]:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record here: {line[:60]!r}")
            head: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head["content-length"])
            row: dict = {c: head.get(h) for c, h in _HEADERS.items()} | {"payload": None}
            for c in ("page_id", "payload_bytes", "refers_to"):
                row[c] = None if row[c] is None else int(row[c])
            row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
            if not self._wanted(row):
                stream.seek(size, 1)
                continue
            if row["record_type"] == "response" and ("payload" in self.fields or self.verify):
                block = stream.read(size)
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if len(block) != size or digest != row["payload_digest"]:
                    raise ValueError(f"record of page {row['page_id']} is damaged")
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
            else:
                stream.seek(size, 1)
            yield row

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t.type) for f, t in zip(self.fields, self.arrow)], schema=self.arrow)

        for path in partition.paths:
            with files.open_input_file(path) as raw:
                stream = io.BufferedReader(_Stream(raw), 1 << 20)
                for row in self._records(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class _Stream:
    """What io.BufferedReader asks of a raw stream, over an Arrow file."""

    def __init__(self, raw):
        self.raw, self.closed = raw, False

    def readable(self):
        return True

    def seekable(self):
        return True

    def writable(self):
        return False

    def readinto(self, out):
        data = self.raw.read(len(out))
        out[: len(data)] = data
        return len(data)

    def seek(self, offset, whence=0):
        return self.raw.seek(offset, whence)

    def tell(self):
        return self.raw.tell()

    def flush(self):
        pass

    def close(self):
        self.closed = True


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: split_bytes, verify (recompute digests of responses)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", 64 << 20)), self.options.get("verify", "true").lower() == "true")


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, *, split_bytes: int = 64 << 20, verify: bool = True) -> DataFrame:
    """The records of the archives below ``path``, with the columns asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return spark.read.format("warc").schema(columns).option("split_bytes", split_bytes).option("verify", str(verify).lower()).load(uri)


def archive_name(folder: str) -> str:
    return f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}"
