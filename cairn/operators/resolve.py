"""Ranked look-ups of requested paths and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import base_name, directory, normalised, stem

MOST_SUGGESTED = 10


def first_existing(requests: DataFrame, files: DataFrame, candidates: str = "candidates", by: tuple[str, ...] = ("request",)) -> DataFrame:
    """For each request the first of its candidate paths that is a file; requests without one are left out."""
    tried = requests.select(*by, F.posexplode(candidates).alias("rank", "path"))
    return tried.join(files.select("path"), "path").groupBy(*by).agg(F.min_by("path", "rank").alias("path"))


def representatives(files: DataFrame, group: Column, preferred: Column, late: Column) -> DataFrame:
    """One path of each group: a preferred one, else one that is not late, else the first."""
    order = F.struct((~preferred).alias("a"), (late & ~preferred).alias("b"), F.col("path").alias("c"))
    return files.select(group.alias("grp"), "path", order.alias("o")).groupBy("grp").agg(F.min_by("path", "o").alias("path"))


def suggestions(pairs: DataFrame, name: str) -> DataFrame:
    """The first ten paths of each request, in order."""
    first = Window.partitionBy("request").orderBy("path")
    kept = pairs.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= MOST_SUGGESTED)
    return kept.groupBy("request").agg(F.array_sort(F.collect_list("path")).alias(name))


def longer_by_extension(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(request, path) of the files that begin with a requested value and a dot, wherever they are.

    A path is cut before each of its dots and joined by equality, so no request is held against all files.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "."))
    rows = files.select("path", F.split("path", r"\.").alias("parts")).filter(F.size("parts") > 1).select("path", F.explode(cuts).alias("value"))
    return rows.join(asked.select("request", "value"), "value").select("request", "path")


def resolve_paths(requests: DataFrame, files: DataFrame, dirs: DataFrame, expected: str = "any") -> DataFrame:
    """(request, path, found, kind, resolved_from, suggestions, warning) of every requested path.

    A file, else a folder, else the dot, else the only file that adds an extension; several such files or similar files
    and folders beside it are suggested. A name is similar if one stem holds the other or two edits part them at most.
    `expected` is file, dir or any. warning is `extended`, `ambiguous`, `similar` or `missing`, null for exact paths.
    """
    if expected not in ("file", "dir", "any"):
        raise ValueError(f"expected must be file, dir or any, not {expected}")
    asked = requests.select("request").distinct().withColumn("value", normalised(F.col("request")))
    there = files.select("path", F.lit("file").alias("is")) if expected != "dir" else files.select("path", F.lit("file").alias("is")).limit(0)
    if expected != "file":
        there = there.unionByName(dirs.select("path", F.lit("directory").alias("is")))
    exact = asked.join(there.select(F.col("path").alias("value"), "is"), "value", "left").groupBy("request", "value").agg(F.max("is").alias("is"))
    exact = exact.withColumn("kind", F.coalesce("is", F.when((F.col("value") == ".") & F.lit(expected != "file"), "directory")))
    beside = there.select("path", directory(F.col("path")).alias("dir"))
    pairs = asked.select("request", "value", directory(F.col("value")).alias("dir")).join(beside, "dir")
    own, other = F.lower(stem(F.col("value"))), F.lower(stem(F.col("path")))
    alike = pairs.filter(F.contains(other, own) | F.contains(own, other) | (F.levenshtein(own, other, 2) >= 0)).select("request", "path").distinct()
    longer = longer_by_extension(asked, files if expected != "dir" else files.limit(0))
    counted = longer.groupBy("request").agg(F.count("*").alias("n"), F.min("path").alias("only"))
    out = exact.join(counted, "request", "left").join(suggestions(longer, "longer"), "request", "left").join(suggestions(alike, "alike"), "request", "left")
    none = F.array().cast("array<string>")
    known, auto = F.col("kind").isNotNull(), F.col("kind").isNull() & (F.col("n") == 1)
    return out.select(
        "request",
        F.when(auto, F.col("only")).otherwise(F.col("value")).alias("path"),
        (known | F.coalesce(auto, F.lit(False))).alias("found"),
        F.when(auto, F.lit("file")).otherwise(F.col("kind")).alias("kind"),
        F.when(auto, F.col("value")).alias("resolved_from"),
        F.when(known, none).otherwise(F.coalesce("longer", "alike", none)).alias("suggestions"),
        F.when(known, None).when(auto, "extended").when(F.col("n") > 1, "ambiguous").when(F.col("alike").isNotNull(), "similar").otherwise("missing").alias("warning"),
    )


def file_table(paths: DataFrame) -> DataFrame:
    """(path, dir, base) of paths."""
    return paths.select("path", directory(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base"))
