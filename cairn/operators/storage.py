"""Tables in the shared folder that cut the lineage of driver loops, and the few file operations that versions need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of the warehouse in a local session where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


class Folder:
    """File operations below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names of the entries, in order; none where there is no such folder."""
        place = self.at(name)
        return sorted(entry.getPath().getName() for entry in self.files.listStatus(place)) if self.files.exists(place) else []

    def exists(self, name: str) -> bool:
        return self.files.exists(self.at(name))

    def age(self, name: str) -> float:
        """Seconds since the entry was written, by the clock of this JVM."""
        return (self.jvm.System.currentTimeMillis() - self.files.getFileStatus(self.at(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self.at(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False if one of that name is there already, which then stays as it is."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        self.write(draft, text)
        place, target = self.files.makeQualified(self.at(draft)), self.files.makeQualified(self.at(name))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(place, target, options)
        except Exception as error:
            self.delete(draft)
            if self.exists(name) and "Exist" in str(error):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder unless it was read from there."""
    return df if getattr(df, "stored_at", None) else materialise(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df, for joins that may meet any number of its rows: they are shuffled, never broadcast.

    Spark reckons a table by its compressed files, and without the rows that an explode adds. Of short alike rows that is
    a small part of what a broadcast takes on the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys over twice the cores, for per-row work on rows that come in few splits."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows of a task whose hash tables grow with them; a larger input gets more tasks, not larger ones.
TASK_ROWS = 500_000


def in_shares(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys so that a task has about TASK_ROWS rows; as it is, where it has fewer. df is counted for it."""
    shares = df.count() // TASK_ROWS
    return df.repartition(shares + 1, *keys) if shares else df


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            Folder(table.sparkSession, path).delete("")
