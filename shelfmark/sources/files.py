"""Files of a directory tree as rows.

Spark's own file sources skip names that start with ``_`` or ``.`` and empty files, so
``__init__.py`` would be lost. This source reads a mounted tree in two levels: the driver goes down only
until there are enough folders to share out, and tasks list what lies below theirs, apply the path rules
before anything is opened, and read. Where there are few folders, several tasks list the same one and
divide its files and the folders in it by the hash of their paths.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import file_url

#: Folders that the driver looks for before tasks take over, how many it names at most, and tasks at least and at most.
PLANNED_FOLDERS, MOST_FOLDERS = 1_000, 20_000
TASKS, MOST_TASKS = 16, 128
FLUSH_BYTES = 4 << 20


class FolderShare(InputPartition):
    """One part in so many of what is in some folders, with all that is below it, and the files directly in others."""

    def __init__(self, deep: list[str], flat: list[str], part: int, parts: int):
        super().__init__(part)
        self.deep, self.flat, self.part, self.parts = deep, flat, part, parts


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.namespace = options.get("namespace", "")
        self.with_content = options.get("content", "true").lower() == "true"
        self.skip_hidden = options.get("hidden", "false").lower() != "true"
        rules = json.loads(options.get("rules", "{}"))
        self.mode, self.rules = rules.get("mode"), {k: set(v) for k, v in rules.get("values", {}).items()}

    def _kept(self, name: str, parents: list[str]) -> bool:
        if self.mode is None:
            return True
        ext = os.path.splitext(name)[1].lower()
        hit = (
            ext in self.rules.get("ext", ())
            or name in self.rules.get("file", ())
            or not self.rules.get("dir", set()).isdisjoint(parents)
        )
        return hit == (self.mode == "include")

    def _entries(self, folder: str) -> tuple[list[str], list[str]]:
        """The folders in a folder, and the names of the files that pass the rules."""
        parents = [part for part in f"{self.namespace}/{folder}".split("/") if part]
        folders, names = [], []
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for entry in entries:
                if (self.skip_hidden and entry.name.startswith(".")) or entry.is_symlink():
                    continue
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir():
                    folders.append(path)
                elif self._kept(entry.name, parents):
                    names.append(path)
        return folders, names

    def partitions(self) -> list[FolderShare]:
        done, level, tasks = [], [""], TASKS
        while level and len(done) + len(level) < PLANNED_FOLDERS:
            below = list(islice((folder for above in level for folder in self._entries(above)[0]), MOST_FOLDERS + 1))
            if not below:
                break
            if len(below) > MOST_FOLDERS:  # tasks divide them
                tasks = MOST_TASKS
                break
            done += level
            level = below
        parts = -(-tasks // max(1, len(level)))
        groups = min(MOST_TASKS, len(level))
        level = sorted(level)
        shares = [FolderShare(level[g::groups], [], i, parts) for g in range(groups) for i in range(parts)]
        return [*shares, FolderShare([], done, 0, 1)] if done else shares

    def _files(self, share: FolderShare) -> Iterator[str]:
        own = lambda path: share.parts == 1 or zlib.crc32(path.encode(errors="surrogateescape")) % share.parts == share.part
        waiting = list(share.deep)
        shared = set(waiting)
        while waiting:
            folder = waiting.pop()
            below, names = self._entries(folder)
            divided = folder in shared
            waiting += filter(own, below) if divided else below
            yield from filter(own, names) if divided else names
        for folder in share.flat:
            yield from self._entries(folder)[1]

    def read(self, partition: FolderShare) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for path in self._files(partition):
            data = None
            if self.with_content:
                with open(os.path.join(self.root, path), "rb") as f:
                    data = f.read()
            paths.append(path)
            contents.append(data)
            size += len(data or b"") + len(path)
            if size > FLUSH_BYTES:
                yield self._batch(paths, contents)
                paths, contents, size = [], [], 0
        if paths:
            yield self._batch(paths, contents)

    def _batch(self, paths: list[str], contents: list[bytes | None]) -> pa.RecordBatch:
        full = [f"{self.namespace}/{p}" if self.namespace else p for p in paths]
        columns = [pa.array([self.namespace] * len(paths)), pa.array(full), pa.array(contents, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["namespace", "file_path", "data"])


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files").option("namespace", "owner/repo").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "namespace string, file_path string, data binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def _rules_option(include: DataFrame | None, exclude: DataFrame | None) -> str:
    if include is not None and exclude is not None:
        raise ValueError("give either inclusion or exclusion rules, not both")
    mode, rules = ("include", include) if include is not None else ("exclude", exclude)
    if rules is None:
        return "{}"
    values: dict[str, list[str]] = {"ext": [], "file": [], "dir": []}
    for row in rules.select("kind", "value").collect():
        values[row["kind"]].append(row["value"].lower() if row["kind"] == "ext" else row["value"])
    return json.dumps({"mode": mode, "values": values})


def _load(spark: SparkSession, root: str, namespace: str, **options: str) -> DataFrame:
    spark.dataSource.register(CorpusFiles)
    return spark.read.format("corpus_files").options(namespace=namespace, **options).load(root)


def decode_text(raw: DataFrame, data: str = "data") -> DataFrame:
    """Bytes to text: rows that are empty or no UTF-8 go, line ends become newlines."""
    text = F.col(data).cast("string")
    valid = raw.filter((F.length(data) > 0) & F.is_valid_utf8(text))
    return valid.withColumn("content", F.regexp_replace(text, "\r\n?", "\n")).drop(data)


def scan_files(
    spark: SparkSession,
    root: str,
    namespace: str,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    host: str = "https://github.com",
    branch: str = "main",
    hidden: bool = False,
) -> DataFrame:
    """``(namespace, file_path, url, content)`` of the text files that pass the rules, ``hidden`` ones only on demand."""
    raw = _load(spark, root, namespace, rules=_rules_option(include, exclude), hidden=str(hidden).lower())
    return decode_text(raw).select(
        "namespace",
        "file_path",
        file_url(F.col("file_path"), F.col("namespace"), host, branch).alias("url"),
        "content",
    )


def scan_metadata_only(
    spark: SparkSession, root: str, namespace: str, include: DataFrame | None = None, exclude: DataFrame | None = None, hidden: bool = False
) -> DataFrame:
    """Paths and links; no file is opened."""
    raw = _load(spark, root, namespace, rules=_rules_option(include, exclude), content="false", hidden=str(hidden).lower())
    return raw.select(
        "namespace", "file_path", file_url(F.col("file_path"), F.col("namespace")).alias("url")
    )
