"""A Python data source for dated matrices: CSV files, gzip or plain, whose header names the instruments and whose first
column is the date.

``spark.read.format("dated_matrix").load(folder)`` gives (field, date, inst, value, error), one row a cell; the field is the
file's name without endings.  Small files share a task, up to ``splitBytes`` of them; a gzip file is never split.  Equality and IN on ``field``
leave files out before they are opened, those on ``inst`` leave columns out, and comparisons of ``date`` leave out lines.

A file is read through before its first cell comes out: one that cannot be read or has no dated line gives a single row with
its ``error``, and the others are not touched.  Cells that are no number are missing.
"""

from __future__ import annotations

import datetime
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "field string, date date, inst string, value double, error string"
ARROW = pa.schema([("field", pa.string()), ("date", pa.date32()), ("inst", pa.string()), ("value", pa.float64()), ("error", pa.string())])
#: Cells of a batch.
BATCH = 1 << 16
CHUNK = 1 << 20


@dataclass
class Files(InputPartition):
    """The files of one task."""

    paths: list[str]


def field_of(path: str) -> str:
    """A file's name without endings; in a folder that Spark wrote, the folder's."""
    parts = path.split("/")
    name = parts[-2] if re.match(r"part-", parts[-1]) and len(parts) > 1 else parts[-1]
    return re.sub(r"(\.csv)?(\.gz)?$", "", name)


def number(cell: str) -> float | None:
    try:
        x = float(cell)
    except ValueError:
        return None
    return None if x != x else x


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, cells: bool):
        self.path, self.split_bytes, self.cells = path, split_bytes, cells
        self.fields: set[str] | None = None
        self.insts: set[str] | None = None
        self.from_, self.to = datetime.date.min, datetime.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what is read; Spark checks every condition again."""
        for f in filters:
            yield f
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("field", "inst") and isinstance(f, (EqualTo, In)):
                own = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                held = self.fields if name == "field" else self.insts
                own = own if held is None else own & held
                self.fields, self.insts = (own, self.insts) if name == "field" else (self.fields, own)
            elif name == "date" and isinstance(getattr(f, "value", None), datetime.date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.from_ = max(self.from_, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.to = min(self.to, f.value)

    def partitions(self) -> list[Files]:
        files, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True))
        found = sorted((i for i in found if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        out, total = [Files([])], 0
        for info in found:
            if self.fields is not None and field_of(info.path) not in self.fields:
                continue
            if out[-1].paths and total + info.size > self.split_bytes:
                out.append(Files([]))
                total = 0
            out[-1].paths.append(info.path)
            total += info.size
        return out

    def _lines(self, files: pyarrow.fs.FileSystem, path: str) -> Iterator[str]:
        """A file's lines; raises where a gzip member is damaged or cut off."""
        with files.open_input_stream(path, compression=None) as stream:
            chunk, rest, member = stream.read(CHUNK), b"", None
            packed = chunk.startswith(b"\x1f\x8b")
            while chunk or packed and member:
                if packed:
                    data = chunk
                    text = b""
                    while data:
                        member = member or zlib.decompressobj(31)
                        text += member.decompress(data)
                        data = member.unused_data
                        if member.eof:
                            member = None
                        elif not data:
                            break
                else:
                    text = chunk
                *whole, rest = (rest + text).split(b"\n")
                for line in whole:
                    yield line.decode("utf-8").rstrip("\r")
                chunk = stream.read(CHUNK)
                if not chunk and member:
                    raise EOFError("the file ends within a gzip member")
            if rest:
                yield rest.decode("utf-8").rstrip("\r")

    @staticmethod
    def _date(cell: str) -> datetime.date | None:
        try:
            return datetime.date.fromisoformat(cell.strip()[:10])
        except ValueError:
            return None

    def _problem(self, files: pyarrow.fs.FileSystem, path: str) -> str | None:
        """Why a file gives no cells, if so."""
        try:
            lines = self._lines(files, path)
            next(lines, None)
            dated = sum(self._date(line.split(",", 1)[0]) is not None for line in lines)
        except (OSError, EOFError, zlib.error, UnicodeDecodeError) as e:
            return f"cannot be read: {e}"
        return None if dated else "no dated rows"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            field = field_of(path)
            if said := self._problem(files, path):
                yield pa.RecordBatch.from_pylist([{"field": field, "error": said}], schema=ARROW)
                continue
            if not self.cells:
                yield pa.RecordBatch.from_pylist([{"field": field}], schema=ARROW)
                continue
            lines = self._lines(files, path)
            head = [c.strip() for c in next(lines).split(",")][1:]
            wanted = [k for k, inst in enumerate(head) if self.insts is None or inst in self.insts]
            names, dates, insts, values = [head[k] for k in wanted], [], [], []
            for line in lines:
                first, *cells = line.split(",")
                date = self._date(first)
                if date is None or not self.from_ <= date <= self.to:
                    continue
                dates += [date] * len(wanted)
                insts += names
                values += [number(cells[k]) if k < len(cells) else None for k in wanted]
                if len(dates) >= BATCH:
                    yield self._batch(field, dates, insts, values)
                    dates, insts, values = [], [], []
            if dates:
                yield self._batch(field, dates, insts, values)

    @staticmethod
    def _batch(field: str, dates: list, insts: list, values: list) -> pa.RecordBatch:
        n = len(dates)
        return pa.RecordBatch.from_arrays([pa.array([field] * n), pa.array(dates, pa.date32()), pa.array(insts, pa.string()), pa.array(values, pa.float64()), pa.nulls(n, pa.string())], schema=ARROW)


def read_matrices(spark: SparkSession, folder: str, *, split_bytes: int = 64 << 20, cells: bool = True) -> DataFrame:
    """(field, date, inst, value, error) of the dated matrices below a folder; without ``cells`` a row a file, which has an
    error or nothing but the field."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
    return spark.read.format("dated_matrix").option("splitBytes", split_bytes).option("cells", str(cells).lower()).load(folder if ":" in folder else f"file://{folder}")


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dated_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), self.options.get("cells", "true") == "true")
