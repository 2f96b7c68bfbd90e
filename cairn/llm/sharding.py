"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters rows by a seeded hash into buckets of about `bucket_bytes`; pass two shuffles each bucket (Spark's
shuffle() is a seeded Fisher-Yates) and numbers the rows. The bucket sizes give every bucket its place in the one
random order, and shards are equal cuts of that order, so row counts differ by one at most.

Null texts count as empty, repeated rows stay separate rows, an empty table gives no rows. Columns of the input that are
named shard or slot give way to the new ones. A row's place in the scan is part of its hash: this is what spreads repeated
rows, which would otherwise share a bucket. Pass one writes its buckets to the shared folder, and all that follows reads
them there, so that counts and rows agree however the scan is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.shared import stored

#: Offsets of at most this many buckets are broadcast (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
LOT = 1024


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 24_000_000) -> DataFrame:
    """All columns of docs, and shard (0 .. n_shards-1), slot (gapless from 0 in each shard)."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64
    total = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).first()
    n_buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    rows = total["rows"]
    place = F.struct(F.col(id_col), F.monotonically_increasing_id().alias("at"))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    scattered = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), place.alias("place"))
    scattered = stored(scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(n_buckets)).cast("int")))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    # sums before a bucket: within its lot of LOT buckets, and over the lots before
    counts = counts.withColumn("lot", F.floor(F.col("bucket") / LOT))
    lots = counts.groupBy("lot").agg(F.sum("n").alias("lot_n"))
    lots = lots.select("lot", (F.sum("lot_n").over(Window.orderBy("lot")) - F.col("lot_n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("lot").orderBy("bucket")) - F.col("n")
    offsets = counts.withColumn("within", within).join(F.broadcast(lots) if n_buckets <= LOT * BROADCAST_BUCKETS else lots, "lot").select("bucket", (F.col("before") + F.col("within")).alias("base"))
    if n_buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    filled = scattered.repartitionById(n_buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
    dealt = filled.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", seed).alias("rows"))
    placed = dealt.join(offsets, "bucket").select((F.col("base")).alias("base"), F.posexplode("rows").alias("i", "entry"))
    position = F.col("base") + F.col("i")
    shard = F.floor(((position + 1) * n_shards - 1) / F.lit(max(rows, 1))).cast("int")
    placed = placed.select(F.col("entry.row").alias("row"), position.alias("position"), shard.alias("shard"))
    first = F.floor(F.col("shard").cast("long") * F.lit(rows) / F.lit(n_shards)).cast("long")
    return placed.select("row.*", "shard", (F.col("position") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as Parquet folders shard=K whose files hold the rows in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
