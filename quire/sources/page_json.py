"""A data source for page JSON, batch and stream, that keeps what cannot be read, with the reason."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructType

from quire.sources.pages import PAGE

QUARANTINE = "file string, at bigint, reason string, raw string"
_BITS = {LongType: 63, IntegerType: 31}


class _Misfit(ValueError):
    pass


def _fitted(value, kind: DataType, where: str):
    """The value as the type asks for, or an error that says where it does not fit. A null fits, and so does a field that
    the type doesn't name: it is left out."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            raise _Misfit(f"{where}: not an object")
        return tuple(_fitted(value.get(f.name), f.dataType, f"{where}.{f.name}" if where else f.name) for f in kind)
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            raise _Misfit(f"{where}: not a list")
        return [_fitted(v, kind.elementType, f"{where}[{i}]") for i, v in enumerate(value)]
    wanted = {LongType: int, IntegerType: int, BooleanType: bool, StringType: str}[type(kind)]
    if type(value) is not wanted or (wanted is int and not -(1 << _BITS[type(kind)]) <= value < 1 << _BITS[type(kind)]):
        raise _Misfit(f"{where}: not a {kind.simpleString()}")
    return value


def read_page(line: bytes, shape: StructType) -> tuple[tuple | None, str | None]:
    """(page, null) or (null, why the line is no page)."""
    try:
        value = json.loads(line.decode("utf-8"))
        page = _fitted(value, shape, "") if isinstance(value, dict) else None
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except _Misfit as why:
        return None, str(why)
    except (ValueError, RecursionError):
        return None, "not JSON"
    if page is None:
        return None, "not an object"
    if page[shape.names.index("page_id")] is None:
        return None, "page_id: missing"
    return page, None


@dataclass
class Span(InputPartition):
    """The lines of a file that begin in a range of its bytes."""

    file: str
    start: int
    end: int


def _located(path: str):
    """The file system that the path names, and the place in it. A path without one is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) below the path in order of their names, without hidden ones."""
    from pyarrow import fs

    system, base = _located(path)
    top = system.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True)) if top.type == fs.FileType.Directory else [top]
    hidden = lambda name: any(part.startswith(("_", ".")) for part in name[len(base) :].split("/"))
    return sorted((i.path, i.size) for i in found if i.is_file and not hidden(i.path))


def _spans(files: list[tuple[str, int]], size: int) -> list[Span]:
    return [Span(file, at, min(at + size, n)) for file, n in files for at in range(0, n, size)]


class _Pages:
    def __init__(self, schema: StructType, options: dict):
        self.path, self.size = options["path"], int(options.get("split", 64 << 20))
        self.shape = StructType([f for f in schema if f.name not in ("file", "at", "reason", "raw")])

    def read(self, span: Span) -> Iterator[tuple]:
        system, _ = _located(self.path)
        none = (None,) * len(self.shape)
        with io.BufferedReader(system.open_input_file(span.file), 1 << 20) as file:
            at = max(span.start - 1, 0)
            file.seek(at)
            at += len(file.readline()) if span.start else 0  # the line before this range is the range before's
            while at < span.end and (line := file.readline()):
                if text := line.strip():
                    page, why = read_page(text, self.shape)
                    yield (*(page or none), span.file, at, why, None if page else text.decode("utf-8", "replace"))
                at += len(line)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Span]:
        return _spans(_files(self.path), self.size)


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max((file for file, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans([f for f in _files(self.path) if start["after"] < f[0] <= end["after"]], self.size)


class PageSource(DataSource):
    """SRC-01: format `page_json`: page JSON, one page a line, below `path`: the columns of a page, then file, at (the byte at which
    the line begins), reason and raw. A line that is no page by the schema, that isn't JSON or UTF-8, or that has no
    page_id gives a row with its reason and text and no page: no line fails the read, and none is lost but empty ones.

    A file is dealt in ranges of `split` bytes (64 MB); a task holds a line at a time. Only the names and sizes of the files
    go through the driver, and the path is of a file system that Arrow opens. As a stream, files are taken in order of their names: a new one must have a later name than
    those before it, as names that begin with a time have.
    """

    @classmethod
    def name(cls) -> str:
        return "page_json"

    def schema(self) -> str:
        return f"{PAGE}, {QUARANTINE}"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:  # noqa: N802
        return _StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session: then spark.read.format("page_json").load(path), and readStream alike."""
    spark.dataSource.register(PageSource)
