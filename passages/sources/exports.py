"""Document exports as JSON text sequences (RFC 7464): each record is the byte 0x1E, a JSON object and a line feed.

JSON escapes the byte inside texts, so a file may be cut anywhere: a record belongs to the byte range that its 0x1E lies in, and large files
are read by many tasks. ``register(spark)`` makes the format known as ``document_export``::

    spark.read.format("document_export").option("text", "body").option("source", "name").load(folder)

gives (source, text): a missing or null source is ``?``, a missing or null text null, other fields are left out, values that are no strings come as
JSON. Options: ``text`` and ``source`` (the fields' names), ``range`` (bytes of a range, 64 MB), ``malformed``: ``fail`` (default) stops at a record that is
no JSON object, ``drop`` leaves it out, as the standard advises for logs that were cut off. Empty files and folders give no rows.

``register(spark, pushdown=True)`` and the option ``pushdown=true`` of a load let equality, lists and prefixes of ``source`` be tested in the reader, before
rows are made. Both are off unless asked for: Spark 4.1 keeps what was pushed with the loaded DataFrame, so that one which is read again without a
filter misses rows. Load anew for each filter where it is on.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

FORMAT = "document_export"
_MARK = b"\x1e"
_READ = 1 << 20  # bytes read at once
_BATCH = 1 << 22  # bytes of records in a batch


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """(address, size) of a file, or of a folder's files but those whose names begin with ``_`` or ``.``."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    hidden = lambda x: any(p[:1] in "_." for p in x.path[len(inner) :].split("/") if p)
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and (x is info or not hidden(x)))


def records(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of each record of an open file whose mark lies in [start, end); a record is held whole, the file is not."""
    file.seek(start)
    at, rest, inside = start, b"", False  # ``rest`` begins at ``at``; if ``inside``, with a mark
    while True:
        if not inside:
            found = rest.find(_MARK)
            at, rest, inside = (at + found, rest[found:], True) if found >= 0 else (at + len(rest), b"", False)
            if at >= end:
                return
        stop = rest.find(_MARK, 1) if inside else -1
        if stop >= 0:
            yield at, rest[1:stop]
            at, rest = at + stop, rest[stop:]
            if at >= end:
                return
            continue
        more = file.read(_READ)
        if not more:
            if inside:
                yield at, rest[1:]
            return
        if inside:  # a long record grows by parts that are joined once
            parts = [rest, more]
            while _MARK not in parts[-1] and (more := file.read(_READ)):
                parts.append(more)
            rest = b"".join(parts)
        else:
            rest = more


class ExportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("an export is loaded from a path")
        self.path, self.text, self.source = options["path"], options.get("text", "text"), options.get("source", "source")
        self.size, self.malformed = int(options.get("range", 64 << 20)), options.get("malformed", "fail")
        if self.size <= 0 or self.malformed not in ("fail", "drop"):
            raise ValueError("need a positive range, and fail or drop for malformed")
        self.tests: list[tuple[str, object]] = []

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(at + self.size, n)) for p, n in _files(self.path) for at in range(0, n, self.size)]

    def _wanted(self, source: str) -> bool:
        return all(source.startswith(x) if kind == "prefix" else source in x for kind, x in self.tests)

    def _parsed(self, path: str, at: int, raw: bytes) -> tuple[str, str | None] | None:
        try:
            row = json.loads(raw)
            if not isinstance(row, dict):
                raise ValueError("no object")
        except ValueError as e:
            if self.malformed == "drop":
                return None
            raise ValueError(f"{path}, byte {at}: {e}") from None
        told = [x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in (row.get(self.source), row.get(self.text))]
        return ("?" if told[0] is None else told[0]), told[1]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("text", pa.string())])
        rows, held = [], 0
        system, inner = _opened(partition.path)
        with system.open_input_file(inner) as file:
            for at, raw in records(file, partition.start, partition.end):
                row = self._parsed(partition.path, at, raw) if raw.strip() else None
                if row is not None and self._wanted(row[0]):
                    rows.append(row)
                    held += len(raw)
                if held >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema)


class FilteredReader(ExportReader):
    """The reader of a load that asks for ``pushdown``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("source",):
                self.tests.append(("prefix", f.value) if isinstance(f, StringStartsWith) else ("among", {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source string, text string"

    def reader(self, schema) -> ExportReader:
        options = dict(self.options)
        return (FilteredReader if options.get("pushdown", "false").lower() == "true" else ExportReader)(options)


def register(spark: SparkSession, pushdown: bool = False) -> None:
    """Makes the format known to the session; ``pushdown`` lets filters reach the loads that ask for them."""
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExportSource)


def save(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All columns of ``docs`` as an export, written by column functions; null fields are left out."""
    record = F.concat(F.lit("\x1e"), F.to_json(F.struct(*docs.columns)))
    docs.select(record.alias("value")).write.mode(mode).text(path)
