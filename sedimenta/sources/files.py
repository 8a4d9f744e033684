"""Data sources over file trees: a scan whose partitions are directories, and a stream of numbered lists of changes.

spark.read.format("corpus-files").option("root", uri): the indexable files below root. Filters on path (prefix, equality) and language are
taken over: directories that cannot hold such a path are not listed.
spark.readStream.format("corpus-changes").option("root", uri): the changes that root's lists name, in the order of their numbers.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith

from .corpus import ALWAYS, EXTENSIONS, LARGEST, ignore_regex

SCHEMA = "path string, content string, content_hash string, last_modified long, size_bytes long, language string"
#: Levels of directories that are partitions of their own; a partition below them is a whole tree.
LEVELS = 2


def opened(uri: str):
    """The file system and path of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def is_ignored(path: str, patterns: list[tuple[bool, re.Pattern]]) -> bool:
    out = False
    for back, pattern in patterns:
        if pattern.search(path):
            out = not back
    return out


class Tree(InputPartition):
    """A directory below the root (without a slash at the end; empty: the root), whole or only its own files."""

    def __init__(self, directory: str, whole: bool):
        super().__init__(None)
        self.directory, self.whole = directory, whole


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.largest = int(options.get("largest", LARGEST))
        self.lines = [*ALWAYS, *options.get("ignore", "").split("\n")]
        self.prefix, self.path, self.language = "", None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and self.path is None:
                self.path = self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("language",) and self.language is None:
                self.language = f.value
            else:
                yield f

    def _may_hold(self, directory: str) -> bool:
        inside = f"{directory}/" if directory else ""
        return inside.startswith(self.prefix) or self.prefix.startswith(inside)

    def partitions(self) -> list[Tree]:
        from pyarrow import fs

        files, base = opened(self.root)
        level, out = [""], []
        for depth in range(LEVELS + 1):
            below = []
            for d in level:
                if depth == LEVELS:
                    out.append(Tree(d, True))
                    continue
                out.append(Tree(d, False))
                for f in files.get_file_info(fs.FileSelector(f"{base}/{d}".rstrip("/"), allow_not_found=True)):
                    name = f"{d}/{f.base_name}".lstrip("/")
                    if f.type == fs.FileType.Directory and not f.base_name.startswith(".") and self._may_hold(name):
                        below.append(name)
            level = below
        return out

    def read(self, partition: Tree) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = opened(self.root)
        patterns = [(back, re.compile(regex)) for back, regex in map(ignore_regex, filter(lambda x: x and not x.startswith("#"), map(str.strip, self.lines)))]
        names = [x.name for x in pa.schema([(n, pa.string()) for n in ("path", "content", "content_hash")])] + ["last_modified", "size_bytes", "language"]
        kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()]
        rows, held = [], 0
        for f in files.get_file_info(fs.FileSelector(f"{base}/{partition.directory}".rstrip("/"), recursive=partition.whole, allow_not_found=True)):
            path = f.path[len(base) :].lstrip("/")
            language = EXTENSIONS.get(f.extension)
            wanted = path.startswith(self.prefix) and self.path in (None, path) and self.language in (None, language)
            if f.type != fs.FileType.File or language is None or not wanted or f.size > self.largest or re.search(r"(^|/)\.", path) or is_ignored(path, patterns):
                continue
            with files.open_input_stream(f.path) as source:
                raw = source.read()
            rows.append((path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), int(f.mtime_ns // 1_000_000_000) if f.mtime_ns else None, f.size, language))
            held += len(raw)
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


class Files(DataSource):
    """The indexable files of a tree: hidden and ignored ones, other extensions and files over `largest` bytes are left out before they are opened."""

    @classmethod
    def name(cls) -> str:
        return "corpus-files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(dict(self.options))


class ListOf(InputPartition):
    def __init__(self, number: int):
        super().__init__(None)
        self.number = number


class ChangesReader(DataSourceStreamReader):
    """Offsets are numbers of lists: a batch is the lists after its start up to its end, one partition each, and reads the same when it is asked for again."""

    def __init__(self, options: dict[str, str]):
        self.root, self.most = options["root"].rstrip("/"), int(options.get("maxListsPerTrigger", 0))
        self.at = None

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        files, base = opened(self.root)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(\d+)\.jsonl", f.base_name)))

    def initialOffset(self) -> dict:
        return {"list": 0}

    def latestOffset(self) -> dict:
        return {"list": max(self._numbers(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[ListOf]:
        return [ListOf(n) for n in self._numbers() if start["list"] < n <= end["list"]]

    def read(self, partition: ListOf) -> Iterator[tuple]:
        files, base = opened(self.root)
        with files.open_input_stream(f"{base}/{partition.number}.jsonl") as source:
            for k, line in enumerate(source.read().decode().splitlines()):
                x = json.loads(line)
                yield x["path"], x["op"], partition.number * 1_000_000 + k, x.get("content")

    def commit(self, end: dict) -> None:
        pass


class Changes(DataSource):
    """(path, op, seq, content) of the lists <number>.jsonl below root."""

    @classmethod
    def name(cls) -> str:
        return "corpus-changes"

    def schema(self) -> str:
        return "path string, op string, seq long, content string"

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets filters go down to them."""
    spark.dataSource.register(Files)
    spark.dataSource.register(Changes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_files(rows: DataFrame, root: str) -> int:
    """Writes rows (path, content) as files below root, each under another name first, so that a task that runs again leaves whole files. Returns how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                folder = f"{base}/{path}".rpartition("/")[0]
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(name := f"{folder}/.{uuid.uuid4().hex}") as sink:
                    sink.write(content.encode())
                files.move(name, f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return sum(r["n"] for r in rows.select("path", "content").mapInArrow(write, "n long").groupBy().sum("n").toDF("n").collect() if r["n"])
