"""Changes of a source tree as a streaming data source (S11): what was added, changed and unlinked since the last look.

    spark.dataSource.register(TreeChangesSource)
    spark.readStream.format("cairn_tree_changes").option("root", root).option("log", log).load()

Columns: path, event (add, change, unlink), seq. Each look lists the tree (size and time of every file) and, where something
differs, writes the listing to the folder `log` as the next numbered one, whole or not at all. An offset is the number of a
listing, so a batch is the difference of two listings, and comes out alike when it is asked for again: after a restart from the
query's checkpoint no event is lost, and none but those of an unfinished batch come twice. Listings that the query has
committed past are deleted. What is there at the first look counts as known (option initial=true: as added).

root and log must be folders that the driver and all executors see. A file that is rewritten with the same size within one tick of
the file system's clock is not noticed. Option `ignore` holds rules divided by line feeds; links are not followed. As for any
file source, the driver lists the tree; each task then reads the two listings and gives the paths of its share.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import zlib

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cairn.functions.ignore import ScanConfig, ignore_regex


def listing(root: str, ignored: re.Pattern) -> dict[str, list[int]]:
    """path: [size, time of change] of every file."""
    out, todo = {}, [""]
    while todo:
        folder = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except FileNotFoundError:  # gone meanwhile
            continue
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if ignored.search(path) or entry.is_symlink():
                continue
            if entry.is_dir():
                todo.append(path)
                continue
            try:
                stat = entry.stat()
            except FileNotFoundError:
                continue
            out[path] = [stat.st_size, stat.st_mtime_ns]
    return out


def differences(before: dict, now: dict):
    """(path, event), by path."""
    for path in sorted(before.keys() | now.keys()):
        if path not in now:
            yield path, "unlink"
        elif path not in before:
            yield path, "add"
        elif before[path] != now[path]:
            yield path, "change"


class Log:
    """Numbered listings in a folder."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def place(self, number: int) -> str:
        return os.path.join(self.folder, f"{number:012d}.json.gz")

    def numbers(self) -> list[int]:
        return sorted(int(name[:12]) for name in os.listdir(self.folder) if name.endswith(".json.gz"))

    def read(self, number: int) -> dict:
        with gzip.open(self.place(number), "rt") as file:
            return json.load(file)

    def write(self, number: int, found: dict) -> None:
        draft = f"{self.place(number)}.draft"
        with gzip.open(draft, "wt") as file:
            json.dump(found, file)
        os.replace(draft, self.place(number))

    def delete_before(self, number: int) -> None:
        for old in self.numbers():
            if old < number:
                os.remove(self.place(old))


class Share(InputPartition):
    def __init__(self, start: int, end: int, k: int, n: int):
        super().__init__((start, end, k, n))
        self.start, self.end, self.k, self.n = start, end, k, n


class TreeChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        rules = options["ignore"].split("\n") if "ignore" in options else ScanConfig().rules()
        self.root, self.log_folder, self.ignored = options["root"], options["log"], ignore_regex(rules)
        self.initial, self.shares = options.get("initial", "false").lower() == "true", max(1, int(options.get("partitions", "4")))

    def begun(self) -> Log:
        """The log, with what is known from the start as its first listing; Spark may ask for either offset first."""
        log = Log(self.log_folder)
        if not log.numbers():
            log.write(0, {} if self.initial else listing(self.root, re.compile(self.ignored)))
        return log

    def initialOffset(self) -> dict:
        return {"listing": self.begun().numbers()[0]}

    def latestOffset(self) -> dict:
        log = self.begun()
        last = max(log.numbers())
        now = listing(self.root, re.compile(self.ignored))
        if now != log.read(last):
            last += 1
            log.write(last, now)
        return {"listing": last}

    def partitions(self, start: dict, end: dict):
        return [Share(start["listing"], end["listing"], k, self.shares) for k in range(self.shares)]

    def read(self, partition: Share):
        log = Log(self.log_folder)
        before = log.read(partition.start)
        for number in range(partition.start + 1, partition.end + 1):
            now = log.read(number)
            for path, event in differences(before, now):
                if zlib.crc32(path.encode()) % partition.n == partition.k:
                    yield path, event, number
            before = now

    def commit(self, end: dict) -> None:
        Log(self.log_folder).delete_before(end["listing"])


class TreeChangesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_tree_changes"

    def schema(self) -> str:
        return "path string, event string, seq bigint"

    def streamReader(self, schema):
        return TreeChangesReader(dict(self.options))
