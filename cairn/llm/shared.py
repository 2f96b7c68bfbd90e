"""Keys and shared-folder tables used by several operators."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one beside the warehouse in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


#: Spark then drops the shuffle files of an execution as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch on its way to Python, as far as rows go, and rows of a Parquet file that are decoded at once.
BATCH_SIZE, ROWS_READ = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: For tables of long rows: Parquet looks at its buffers after each row (else after 100), and so keeps row groups small.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session's settings for what runs meanwhile."""
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, batch_rows: int | None = None, *, conf: dict[str, str] | None = None, long_rows: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here and lost executors cost no recomputation.

    batch_rows is the most rows of an Arrow batch on the way, for rows that hold long values; conf are other settings for
    the step. long_rows: the rows that are written are of megabytes each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {}) | (conf or {})):
        df.write.options(**LONG_ROWS if long_rows else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text) with rid unique, not null and in the order of id.

    Where ids are unique and not null, rid is the id. Otherwise rows are ordered by (id with nulls last, text) and
    numbered in that order, so repeated rows become separate documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.groupBy("id").agg(F.count("*").alias("n"))
    bad = ids.filter((F.col("n") > 1) | F.col("id").isNull()).limit(1).count()
    if not bad:
        return rows.select(F.col("id").alias("rid"), "id", "text")
    # equal rows are interchangeable: their place in the scan parts them, so that many of them are not one task's
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first(), F.col("at").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.select(F.monotonically_increasing_id().alias("rid"), "id", "text"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are over: it does so when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
