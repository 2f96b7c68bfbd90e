"""Corpus preparation as a chain of operators, each stage written and read again.

A stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of documents;
the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.decontaminate import decontaminate
from cairn.llm.mixing import mix_to_targets
from cairn.llm.ngram_join import jaccard_classes
from cairn.llm.shared import shared_folder, stored
from cairn.llm.sharding import shuffle_into_shards
from cairn.llm.toxicity import fit, score_documents

#: Share of tokens wanted of rows that the labels' `quality` classifier holds for 0 and for 1.
MIX = {0: 0.4, 1: 0.6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models hold for toxic go.

    Each row is judged by its own text: repeated rows fare alike, ids and other columns are not looked at. Null and empty
    texts get the score of a text without words and are kept unless that is a toxic one. Without labels of both classes all
    rows stay; an empty table stays empty.
    """
    scored = score_documents(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter("predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: the one with the smallest id, nulls last. Rows without words stay.

    Where ids are whole numbers, unique and not null, they name the rows. Else rows are numbered and stored first, so that
    rows of repeated or null ids are rows of their own, and every later scan sees the same numbers. Columns of any name
    come out as they were. An empty table stays empty.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        rows = docs.select(F.col("doc_id").cast("bigint").alias("place"), row)
    else:
        rows = stored(docs.select(F.monotonically_increasing_id().alias("place"), row))
    classes = jaccard_classes(rows.select("place", "row.text"), id_col="place").select("rid", "keeper")
    ids = rows.select("place", "row.doc_id").join(classes, F.col("place") == F.col("rid"))
    kept = ids.groupBy("keeper").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("least"))
    return rows.join(kept.select(F.col("least.place").alias("place")), "place", "left_semi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go.

    Null and empty texts hold none; repeated rows fare alike; ids and other columns are not looked at. Without benchmark
    items all rows stay; an empty table stays empty.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), action="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows appear as often as the fitted rates say.

    A row's rate follows from its text: repeated rows have one rate, null and empty texts have rate 1. Where labels name
    one domain only, or none, every rate is 1. An empty table stays empty.
    """
    return mix_to_targets(docs, table(spark, sf_dir, "labels"), MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, shuffled into eight shards, with shard and slot (which replace columns of these names).

    Row counts of shards differ by one at most. Null texts and repeated rows are rows like all others; an empty table stays
    empty.
    """
    return shuffle_into_shards(docs, 8)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]
#: SQL states neither the toxicity models nor the fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
