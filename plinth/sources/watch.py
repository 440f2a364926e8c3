"""A streaming source of changes to a source tree, deletions among them.

The source compares listings. A listing (path, modified, size) of the source files is a Parquet file in a folder of the
source's own, numbered; the offset is its number. A batch is the difference of two listings, dealt out by path, so a
query that starts again from its checkpoint goes on from the listing that it had reached, and what changed meanwhile is in
its next batch. Listings behind a committed offset are deleted. Files below ignored directories, or that no reader knows, aren't listed.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("root", "/src").option("listings", "/shared/listings").load()
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from plinth.functions.text import IGNORED_DIRS, LANGUAGES

_LISTING = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])


def is_ignored(directory: str) -> bool:
    return directory in IGNORED_DIRS or len(directory) > 1 and directory.startswith(".")


def listing(root: str) -> pa.Table:
    """The source files under a root of any file system that Arrow knows; directories that are ignored aren't entered."""
    fs, top = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))
    top, rows, todo = top.rstrip("/"), [], [top]
    while todo:
        for x in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
            if x.type == pafs.FileType.Directory:
                if not is_ignored(x.base_name):
                    todo.append(x.path)
            elif x.extension.lower() in LANGUAGES:
                rows.append((x.path[len(top) + 1 :], x.mtime_ns or 0, x.size))
    rows.sort()
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_LISTING)], schema=_LISTING)


class Part(InputPartition):
    def __init__(self, start: int, end: int, number: int, parts: int):
        self.start, self.end, self.number, self.parts = start, end, number, parts


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.parts, self.initial = options["root"], int(options.get("parts", 4)), options.get("initial", "false").lower() == "true"
        where = options["listings"]
        self.fs, self.dir = pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), os.path.abspath(where))
        self.fs.create_dir(self.dir, recursive=True)

    def _path(self, n: int) -> str:
        return f"{self.dir}/listing-{n}.parquet"

    def _numbers(self) -> list[int]:
        names = [x.base_name for x in self.fs.get_file_info(pafs.FileSelector(self.dir))]
        return sorted(int(n[8:-8]) for n in names if n.startswith("listing-") and n.endswith(".parquet"))

    def _save(self, n: int, table: pa.Table) -> None:
        """Under another name first: a listing is there whole or not at all."""
        draft = f"{self.dir}/draft-{n}-{time.time_ns()}"
        pq.write_table(table, draft, filesystem=self.fs)
        self.fs.move(draft, self._path(n))

    def _load(self, n: int) -> pa.Table:
        return pq.read_table(self._path(n), filesystem=self.fs, schema=_LISTING)

    def initialOffset(self) -> dict:
        if not self._numbers():
            self._save(0, _LISTING.empty_table() if self.initial else listing(self.root))
        return {"listing": self._numbers()[0]}

    def latestOffset(self) -> dict:
        numbers, now = self._numbers(), listing(self.root)
        if not numbers:
            self._save(0, _LISTING.empty_table() if self.initial else now)
            numbers = [0]
        if not self._load(numbers[-1]).equals(now):
            numbers.append(numbers[-1] + 1)
            self._save(numbers[-1], now)
        return {"listing": numbers[-1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["listing"], end["listing"], k, self.parts) for k in range(self.parts)]

    def read(self, part: Part) -> Iterator[tuple]:
        """The differences whose paths fall to this part."""
        if part.start == part.end:
            return
        mine = lambda n: {p: (m, s) for p, m, s in zip(*(c.to_pylist() for c in self._load(n).columns), strict=True) if _spread(p) % part.parts == part.number}
        a, b = mine(part.start), mine(part.end)
        at = datetime.fromtimestamp(self.fs.get_file_info(self._path(part.end)).mtime_ns / 1e9, tz=timezone.utc)
        for path in sorted(b):
            if a.get(path) != b[path]:
                yield path, "changed", at
        for path in sorted(a.keys() - b.keys()):
            yield path, "removed", at

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"]:
                self.fs.delete_file(self._path(n))


def _spread(path: str) -> int:
    n = 0
    for b in path.encode():
        n = (n * 31 + b) & 0x7FFFFFFF
    return n


class TreeChanges(DataSource):
    """(path, kind: changed or removed, at) under ``root``; ``listings`` is a folder of its own. initial: begin with all files."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, kind string, at timestamp"

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)
