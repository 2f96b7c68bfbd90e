"""A source tree as a Spark data source (S1, S4): one row for each file, dotfiles included, links not followed.

    spark.dataSource.register(RepositorySource)
    spark.read.format("cairn_repository").option("root", path).load()

Columns: path (posix, relative to root), size, and content (UTF-8; null with option content=false, so that path queries
read no bytes). The driver lists the tree, as for any file source, and deals the files to partitions of about
`partitionBytes` bytes (option, 32 MB), so a large folder is many partitions and small files share one. Filters of `path` (equal,
in a list, by its beginning or end) are pushed down with option pushdown=true, for which Spark wants
`spark.sql.python.filterPushdown.enabled` to be set: folders that cannot hold a match are not listed, other files not opened. root must be a folder that all executors see. Option `ignore` holds rules
divided by line feeds.
"""

from __future__ import annotations

import os
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from cairn.functions.ignore import ScanConfig, ignore_regex

#: What a file costs beside its bytes.
OPEN_BYTES = 64_000


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


class PathFilters:
    """Conditions on paths, and whether a folder may hold a path that meets them all."""

    def __init__(self):
        self.equal: set[str] | None = None
        self.starts: list[str] = []
        self.ends: list[str] = []

    def take(self, given) -> bool:
        if getattr(given, "attribute", None) != ("path",):
            return False
        if isinstance(given, (EqualTo, In)):
            values = {given.value} if isinstance(given, EqualTo) else {v for v in given.value if v is not None}
            self.equal = values if self.equal is None else self.equal & values
        elif isinstance(given, StringStartsWith):
            self.starts.append(given.value)
        elif isinstance(given, StringEndsWith):
            self.ends.append(given.value)
        else:
            return False
        return True

    def file(self, path: str) -> bool:
        return (self.equal is None or path in self.equal) and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))

    def folder(self, path: str) -> bool:
        inside = f"{path}/"
        return (self.equal is None or any(p.startswith(inside) for p in self.equal)) and all(inside.startswith(s) or s.startswith(inside) for s in self.starts)


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        rules = options["ignore"].split("\n") if "ignore" in options else ScanConfig().rules()
        self.ignored = ignore_regex(rules)
        self.content = options.get("content", "true").lower() != "false"
        self.bytes = max(1, int(options.get("partitionbytes", options.get("partitionBytes", str(32 << 20)))))
        self.filters = PathFilters()

    def listed(self):
        """(path, size) of the files that are wanted, folder by folder."""
        ignored, todo = re.compile(self.ignored), [""]
        while todo:
            folder = todo.pop()
            for entry in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name):
                path = f"{folder}/{entry.name}" if folder else entry.name
                if ignored.search(path) or entry.is_symlink():
                    continue
                if entry.is_dir():
                    if self.filters.folder(path):
                        todo.append(path)
                elif self.filters.file(path):
                    yield path, entry.stat().st_size

    def partitions(self):
        parts, held, used = [], [], 0
        for path, size in self.listed():
            cost = OPEN_BYTES + (size if self.content else 0)
            if held and used + cost > self.bytes:
                parts.append(Files(held))
                held, used = [], 0
            held.append((path, size))
            used += cost
        return [*parts, Files(held)]

    def read(self, partition):
        for path, size in partition.files:
            content = None
            if self.content:
                with open(os.path.join(self.root, path), "rb") as file:
                    content = file.read().decode("utf-8", "replace")
            yield path, size, content


class FilteringReader(RepositoryReader):
    """Takes the filters of paths from Spark, which refuses such a reader where its setting is off."""

    def pushFilters(self, filters):
        for given in filters:
            if not self.filters.take(given):
                yield given


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_repository"

    def schema(self) -> str:
        return "path string, size bigint, content string"

    def reader(self, schema):
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown", "false").lower() == "true" else RepositoryReader)(options)
