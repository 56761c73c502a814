"""A folder of files as a table, by a Python data source.

Spark's own binaryFile reader leaves out names that begin with _ or . and reads [ ] in a path as a pattern; a corpus
has such names, so the folder is walked here: its upper levels by the driver, until there are enough folders to deal
out, what lies below them by the tasks. The root is a path that driver and executors share, or a URI of a file system
that Arrow knows.
"""

from __future__ import annotations

import json
import os
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is read and what is left out unless the caller says otherwise. Prefixes are text, not folders.
EXTENSIONS = (".md", ".markdown")
EXCLUDED = (
    "infrastructure/claude-config-backup/",
    "Routines/Wikilink Scan",
)


def selected(rel: str, extensions: tuple[str, ...], exclude: tuple[str, ...]) -> bool:
    """Whether a file takes part: its suffix, in any case, is listed, and its path begins with no excluded prefix."""
    return PurePosixPath(rel).suffix.lower() in extensions and not rel.startswith(tuple(exclude))


def listing(root: str, folder: str = "") -> tuple[list[str], list[str]]:
    """(folders, files) right below a folder of root, as paths from root. Local links to folders are not followed."""
    join = lambda name: f"{folder}/{name}" if folder else name
    if "://" in root:
        system, top = arrow_fs.FileSystem.from_uri(root)
        found = system.get_file_info(arrow_fs.FileSelector(f"{top.rstrip('/')}/{folder}"))
        kinds = (arrow_fs.FileType.Directory, arrow_fs.FileType.File)
        return tuple(sorted(join(x.base_name) for x in found if x.type == k) for k in kinds)
    folders, files = [], []
    with os.scandir(os.path.join(root, folder)) as entries:
        for x in entries:
            if x.is_dir(follow_symlinks=False):
                folders.append(join(x.name))
            elif x.is_file():
                files.append(join(x.name))
    return sorted(folders), sorted(files)


def is_folder(root: str) -> bool:
    if "://" not in root:
        return os.path.isdir(root)
    system, path = arrow_fs.FileSystem.from_uri(root)
    return system.get_file_info(path).type == arrow_fs.FileType.Directory


def walk(root: str, extensions: tuple[str, ...], exclude: tuple[str, ...], folder: str = ""):
    """The files below a folder that take part, as paths from root."""
    todo = [folder]
    while todo:
        folders, files = listing(root, todo.pop())
        todo += folders[::-1]
        yield from (rel for rel in files if selected(rel, extensions, exclude))


def read_file(root: str, rel: str) -> bytes | None:
    try:
        if "://" in root:
            system, top = arrow_fs.FileSystem.from_uri(root)
            with system.open_input_file(f"{top.rstrip('/')}/{rel}") as f:
                return f.read()
        with open(os.path.join(root, rel), "rb") as f:
            return f.read()
    except OSError:
        return None


class _Slice(InputPartition):
    """Files, and folders to be walked."""

    def __init__(self, rels: list[str], folders: list[str] = ()):
        self.rels, self.folders = rels, list(folders)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.extensions = tuple(e.lower() for e in json.loads(options.get("extensions", json.dumps(EXTENSIONS))))
        self.exclude = tuple(json.loads(options.get("exclude", json.dumps(EXCLUDED))))
        self.per_slice = int(options.get("files_per_slice", 2000))
        self.slices = int(options.get("slices", 1000))

    def partitions(self):
        """The levels from the top on are listed one after the other, until a level has `slices` folders or none."""
        level, rels = [""], []
        while level and len(level) < self.slices:
            found = [listing(self.root, x) for x in level]
            rels += [rel for _, files in found for rel in files if selected(rel, self.extensions, self.exclude)]
            level = [x for folders, _ in found for x in folders]
        out = [_Slice(rels[i : i + self.per_slice]) for i in range(0, len(rels), self.per_slice)]
        step = max(1, -(-len(level) // (4 * self.slices)))
        return out + [_Slice([], level[i : i + step]) for i in range(0, len(level), step)] or [_Slice([])]

    def read(self, partition):
        for rel in partition.rels:
            yield rel, read_file(self.root, rel)
        for folder in partition.folders:
            for rel in walk(self.root, self.extensions, self.exclude, folder):
                yield rel, read_file(self.root, rel)


class CorpusFiles(DataSource):
    """Format corpus_files: option root, and optional extensions and exclude as JSON lists."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "rel string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def corpus_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(rel, content) of the corpus files under root; content is null where a file can't be read."""
    spark.dataSource.register(CorpusFiles)
    reader = spark.read.format("corpus_files").option("root", root if "://" in root else os.path.abspath(root))
    return reader.option("extensions", json.dumps(list(extensions))).option("exclude", json.dumps(list(exclude))).load()


def write_files(files: DataFrame, root: str) -> int:
    """Write (rel, content) rows as files below root, in the tasks; their number. A rel that leaves root is an error."""
    root = root if "://" in root else os.path.abspath(root)

    def run(batches):
        system, top = arrow_fs.FileSystem.from_uri(root) if "://" in root else (arrow_fs.LocalFileSystem(), root)
        for b in batches:
            for rel, content in zip(b.column("rel").to_pylist(), b.column("content").to_pylist()):
                if ".." in rel.split("/") or rel.startswith("/"):
                    raise ValueError(f"{rel!r} lies outside the root")
                path = f"{top.rstrip('/')}/{rel}"
                system.create_dir(os.path.dirname(path), recursive=True)
                with system.open_output_stream(path) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    (n,) = files.select("rel", "content").mapInArrow(run, "n long").agg({"n": "sum"}).first()
    return n or 0
