"""What to know first of a repository: the project above a folder (S12), a directory map and a reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import at_least_one, base_name, directory, normalised
from cairn.operators.imports import with_repo
from cairn.operators.storage import shuffled

#: Files that make a folder a project.
PROJECT_MANIFESTS = [
    "package.json", "pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile", "go.mod", "Cargo.toml", "pom.xml",
    "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
]
#: What is read first where it is there.
READ_FIRST = ["README.md", "package.json"]


def folders_above(path: Column) -> Column:
    """(depth, folder) of each folder above a path, from the top one, a dot, on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.when(n == 0, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("folder")))


def project_folders(files: DataFrame) -> DataFrame:
    """(repo, folder) of the folders that hold a project's manifest."""
    home = directory(F.col("path"))
    return with_repo(files).filter(base_name(F.col("path")).isin(PROJECT_MANIFESTS)).select("repo", F.when(home == "", ".").otherwise(home).alias("folder")).distinct()


def upstream_projects(requests: DataFrame, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repo, root, project_root) of every requested folder (repo, root): the nearest folder above it with a manifest.

    A folder's own manifest does not count. known (repo, path), where given, holds the folders in which something was
    detected, and others are passed over. project_root is a dot for the top folder and null where there is none. A folder is
    cut into those above it, which join the projects by equality, so no request walks anything.
    """
    asked = with_repo(requests).select("repo", normalised(F.col("root")).alias("root")).distinct()
    steps = asked.filter("root <> '.'").select("repo", "root", F.explode(folders_above(F.col("root"))).alias("a")).select("repo", "root", "a.depth", "a.folder")
    homes = project_folders(files)
    if known is not None:
        homes = homes.join(shuffled(with_repo(known).select("repo", F.col("path").alias("folder"))), ["repo", "folder"], "left_semi")
    best = steps.join(shuffled(homes), ["repo", "folder"]).groupBy("repo", "root").agg(F.max_by("folder", "depth").alias("project_root"))
    return asked.join(shuffled(best), ["repo", "root"], "left").select("repo", "root", "project_root")


def rebased(paths: DataFrame, prefix: str = "prefix") -> DataFrame:
    """paths below their column prefix, as seen from there; the prefix itself is a dot, and what is not below it is left out."""
    below = F.col("path").startswith(F.concat(F.col(prefix), F.lit("/")))
    cut = F.when(F.col("path") == F.col(prefix), ".").when(below, F.expr(f"substring(path, length(`{prefix}`) + 2)"))
    return paths.withColumn("path", F.when(F.col(prefix) == ".", F.col("path")).otherwise(cut)).filter("path is not null")


def directory_map(files: DataFrame, max_depth=None) -> DataFrame:
    """(repo, entry): folders, with a slash at the end, and files of max_depth segments at most."""
    rows, depth = with_repo(files), at_least_one(max_depth, 4)
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    kept = F.filter(F.concat(F.when(F.size(parts) > 1, ups).otherwise(F.array().cast("array<string>")), F.array("path")), lambda e: F.size(F.filter(F.split(e, "/"), lambda x: x != "")) <= depth)
    return rows.filter("path is not null").select("repo", F.explode(kept).alias("entry")).distinct()


def reading_order(files: DataFrame, entries: DataFrame, important: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(repo, path, place) of the files to read, from place 1 on: the first ones by name, entry points, important files.

    entries and important are (repo, path, place). A path counts where it comes first, and only if it is a file. What is
    found of a repository is a short list, so its window is bounded.
    """
    repos = with_repo(files).select("repo", "path").distinct()
    named = repos.select("repo").distinct().select("repo", F.posexplode(F.array(*map(F.lit, first or READ_FIRST))).alias("place", "path"))
    parts = [rows.select("repo", "path", F.struct(F.lit(k).alias("part"), F.col("place").cast("bigint").alias("place")).alias("rank")) for k, rows in enumerate((named, with_repo(entries), with_repo(important)))]
    once = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("repo", "path").agg(F.min("rank").alias("rank")).join(shuffled(repos), ["repo", "path"], "left_semi")
    return once.select("repo", "path", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "path")).alias("place"))
