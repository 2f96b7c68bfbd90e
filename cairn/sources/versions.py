"""Versioned tables: several tables are published together, and readers keep the version that they opened (T5).

    store = Versions(spark, path)
    store.publish({"edges": edges, "symbols": symbols})
    with store.pinned() as tables:
        tables["edges"].count()

Layout below path: a folder of Parquet tables for each publish; `_versions/<number>.json`, which names a folder and its
tables; `_pins/`, an empty file for each reader. A version is there from the moment its pointer is, which is written whole
under a name that must be new, so a publish that fails or loses a race leaves the version before it as it was.

Collection: a pointer goes first, then its folder, and only if no reader has pinned it. A reader pins a folder before it looks
at the pointer again, so either it sees that the pointer has gone and takes a newer one, or the collector sees its pin.
A publisher pins its folder until the pointer is there, so folders without pointer and pin are what failed publishes left.
Pins older than `pin_seconds` are those of processes that have died.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cairn.operators.storage import Folder


class VersionTaken(RuntimeError):
    """Another publisher has written the version that this one was to become."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, pin_seconds: float = 86_400):
        self.spark, self.folder, self.pin_seconds = spark, Folder(spark, path), pin_seconds

    def numbers(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self.folder.names("_versions") if name.endswith(".json")]

    def latest(self) -> int | None:
        return max(self.numbers(), default=None)

    def pointer(self, version: int) -> dict:
        return json.loads(self.folder.read(f"_versions/{version:020d}.json"))

    def publish(self, tables: dict[str, DataFrame], *, after: int | None = None, notes: dict | None = None) -> int:
        """Write the tables as the version that follows `after` (the latest, if not given); its number.

        notes are kept with the version. VersionTaken is raised where another publish came between.
        """
        after = self.latest() if after is None else after
        version, data = (after or 0) + 1, f"data-{uuid.uuid4().hex}"
        self.folder.write(f"_pins/{data}.publisher", "")
        try:
            for name, table in tables.items():
                table.write.parquet(f"{self.folder.path}/{data}/{name}")
            pointer = {"data": data, "tables": {name: table.schema.json() for name, table in tables.items()}, "notes": notes or {}}
            if not self.folder.write_once(f"_versions/{version:020d}.json", json.dumps(pointer)):
                raise VersionTaken(f"version {version} is there already")
        except BaseException:
            self.folder.delete(data)
            raise
        finally:
            self.folder.delete(f"_pins/{data}.publisher")
        return version

    def open(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version (the latest, if not given), which collection may take away; see pinned."""
        version = self.latest() if version is None else version
        if version is None:
            raise LookupError("nothing has been published")
        pointer = self.pointer(version)
        return {name: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.folder.path}/{pointer['data']}/{name}") for name, schema in pointer["tables"].items()}

    @contextmanager
    def pinned(self, version: int | None = None):
        """The tables of a version (the latest, if not given), which stay while the block runs."""
        while True:
            number = self.latest() if version is None else version
            if number is None or number not in self.numbers():
                raise LookupError("there is no such version")
            pin = f"_pins/{self.pointer(number)['data']}.{uuid.uuid4().hex}"
            self.folder.write(pin, "")
            if self.folder.exists(f"_versions/{number:020d}.json"):
                break
            self.folder.delete(pin)  # collected meanwhile
        try:
            yield self.open(number)
        finally:
            self.folder.delete(pin)

    def collect(self, keep: int = 1) -> list[int]:
        """Take away all versions but the latest `keep`; data that someone has pinned goes with a later collection."""
        gone = sorted(self.numbers())[: -max(1, keep)]
        for version in gone:
            self.folder.delete(f"_versions/{version:020d}.json")
        live = {self.pointer(version)["data"] for version in self.numbers()}
        for pin in self.folder.names("_pins"):
            if self.folder.age(f"_pins/{pin}") > self.pin_seconds:
                self.folder.delete(f"_pins/{pin}")
            else:
                live.add(pin.partition(".")[0])
        for name in self.folder.names():
            if name.startswith("data-") and name not in live:
                self.folder.delete(name)
        return gone
