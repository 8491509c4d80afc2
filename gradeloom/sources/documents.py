"""One file a key, written by executors: JSON documents and workbooks made of rows.

Rows are (file, section, body), all of a file in one task and in order. A file ending in .xlsx is a workbook: the body of its first
row is {"columns": names, "spread": keys, "suffix": text, "blank": value}, and each further body is an object of a value a column and,
under "spread", an object of the values for its keys. Any other file is text: bodies one after the other, with a
comma between two of one section.

A task writes each file under a name of its own; the commit renames those of tasks that succeeded, so a lost or repeated attempt leaves
nothing but a temporary file, which an abort deletes. A file that is there already is left as it is where its content would
not change, and is kept with `.backup` behind its name where it does. Rows stream, so a file may be larger than memory; one task writes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gradeloom.sources import store, workbooks

SCHEMA = "file string, section int, body string"


@dataclass
class Written(WriterCommitMessage):
    """(temporary path, path) of each file that changes."""

    files: list[tuple[str, str]]


class _Text:
    def __init__(self, stream):
        self.stream, self.last = stream, None

    def put(self, section: int, body: str) -> None:
        self.stream.write(((",\n" if section == self.last else "") + body).encode())
        self.last = section

    def close(self) -> None:
        self.stream.close()


class _Book:
    def __init__(self, stream):
        self.stream, self.book = stream, None

    def put(self, section: int, body: str) -> None:
        told = json.loads(body)
        if self.book is None:
            self.columns, self.spread, self.blank = told["columns"], told.get("spread") or [], told.get("blank")
            self.book = workbooks.Writer(_Whole(self.stream), [*self.columns, *(f"{k}{told.get('suffix') or ''}" for k in self.spread)])
        else:
            more = told.get("spread") or {}
            self.book.row([*(told.get(c) for c in self.columns), *(more.get(k, self.blank) for k in self.spread)])

    def close(self) -> None:
        if self.book is not None:
            self.book.close()
        self.stream.close()


class _Whole:
    """A stream for zipfile, which counts its own place where it can't ask."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with its store (as `store.qualified` gives it), and the path there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if rest else path
    owner, _, inner = rest.removeprefix("//").partition("/")
    filesystem, base = pafs.FileSystem.from_uri(f"{scheme}://{owner}/")
    return filesystem, f"{base.rstrip('/')}/{inner}"


def _same(filesystem: pafs.FileSystem, a: str, b: str) -> bool:
    x, y = filesystem.get_file_info([a, b])
    if pafs.FileType.NotFound in (x.type, y.type) or x.size != y.size:
        return False
    with filesystem.open_input_stream(a) as f, filesystem.open_input_stream(b) as g:
        while part := f.read(1 << 20):
            if part != g.read(len(part)):
                return False
    return True


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        filesystem, root = place(self.path)
        done, file, out, temporary = [], None, None, None

        def end():
            out.close()
            if _same(filesystem, temporary, f"{root}/{file}"):
                filesystem.delete_file(temporary)
            else:
                done.append((temporary, f"{root}/{file}"))

        for batch in iterator:
            for name, section, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != file:
                    if out is not None:
                        end()
                    file, temporary = name, f"{root}/{name}.{uuid.uuid4().hex}.writing"
                    filesystem.create_dir(temporary.rpartition("/")[0], recursive=True)
                    stream = filesystem.open_output_stream(temporary)
                    out = _Book(stream) if name.endswith(".xlsx") else _Text(stream)
                out.put(section, body)
        if out is not None:
            end()
        return Written(done)

    def commit(self, messages) -> None:
        filesystem, _ = place(self.path)
        files = [x for m in messages if m is not None for x in m.files]
        if len({path for _, path in files}) < len(files):
            raise ValueError("rows of one file were in several tasks")
        for temporary, path in files:
            if filesystem.get_file_info(path).type != pafs.FileType.NotFound:
                filesystem.move(path, f"{path}.backup")
            filesystem.move(temporary, path)

    def abort(self, messages) -> None:
        filesystem, _ = place(self.path)
        for temporary, _ in (x for m in messages if m is not None for x in m.files):
            if filesystem.get_file_info(temporary).type != pafs.FileType.NotFound:
                filesystem.delete_file(temporary)


class KeyedFiles(DataSource):
    """The sink as a format of Spark's writer."""

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write(rows: DataFrame, path: str, order: list[str]) -> str:
    """Writes rows (file, section, body and what they are ordered by within a section) as files below path."""
    rows.sparkSession.dataSource.register(KeyedFiles)
    dealt = rows.repartition("file").sortWithinPartitions("file", "section", *order).select("file", "section", "body")
    dealt.write.format("keyed_files").mode("append").option("path", store.qualified(rows.sparkSession, path)).save()
    return path
