"""The context record of served folders (E1) and the health report of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import base_name, in_locale_order, normalised
from cairn.operators.context import folders_above, project_folders, upstream_projects
from cairn.operators.detect import MANIFESTS, detect, facts
from cairn.operators.findings import findings
from cairn.operators.imports import with_repo
from cairn.operators.storage import materialise, shuffled
from cairn.sources.manifests import json_of

#: Divides a repository's name from a folder in keys; no path holds it.
BETWEEN = "\0"


def below(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """rows (repo, path, ..) once for each of the folders (repo, folder) above them, as seen from there; repo is then both."""
    rest = F.when(F.col("folder") == ".", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    above = rows.select("*", F.explode(F.transform(folders_above(F.col("path")), lambda x: x["folder"])).alias("folder"))
    return above.join(shuffled(folders), ["repo", "folder"]).withColumn("path", rest).withColumn("repo", F.concat("repo", F.lit(BETWEEN), "folder")).drop("folder")


def records(found: DataFrame, technologies: DataFrame) -> DataFrame:
    """(repo, project_name, tech, features, entries, important, scripts): one row for each repo of which something is known."""
    def listed(output: str) -> Column:
        kept = F.when(F.col("output") == output, F.struct("place", "path", "text"))
        return F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"))).alias(output)

    def values(output: str) -> Column:
        kept = F.when(F.col("output") == output, in_locale_order(F.col("value")))
        return F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.collate(x, "UTF8_BINARY")).alias(output)

    of_paths = found.groupBy("repo").agg(F.max(F.when(F.col("output") == "name", F.col("text"))).alias("project_name"), listed("entry"), listed("important"), listed("script"))
    return technologies.groupBy("repo").agg(values("tech"), values("feature")).join(shuffled(of_paths), "repo", "full")


def contexts(requests: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """A record of every requested folder (repo, root): (repo, root, project_name, tech, features, entry_points,
    important_files, scripts, project_root, workspace_files, warning).

    What counts is below the folder. Where nothing is found there, the nearest folder above it with a manifest in which
    something is found (S12) stands in: project_root is that folder, warning is `upstream`, entry points and important files
    are those below the served folder as seen from it, and workspace_files are the important files elsewhere in the project.
    Where there is none either, warning is `no_project`. Without a name the project has that of its folder, or of the
    repository at the top. Lists are as long as a project's important files; they are never null. Folders without files give
    a record too; null paths and roots do not count.
    """
    asked = materialise(with_repo(requests).filter("root is not null").select("repo", normalised(F.col("root")).alias("root")).distinct())
    paths = with_repo(files).filter("path is not null").select("repo", "path")
    wanted = base_name(F.col("path")).isin([*MANIFESTS, "schema.prisma"]) | F.col("path").rlike(r"(^|/)\.github/workflows/.+\.ya?ml$")
    texts = with_repo(contents).filter(wanted).select("repo", "path", "content")
    above = asked.filter("root <> '.'").select("repo", F.explode(F.transform(folders_above(F.col("root")), lambda x: x["folder"])).alias("folder"))
    folders = materialise(asked.select("repo", F.col("root").alias("folder")).unionByName(above.join(shuffled(project_folders(paths)), ["repo", "folder"], "left_semi")).distinct())
    near_files, near_texts = materialise(below(paths, folders)), materialise(below(texts, folders))
    known = materialise(facts(near_files, near_texts))
    held = records(findings(near_files, near_texts, known), detect(near_files, near_texts, known))
    held = materialise(held.withColumn("at", F.split("repo", BETWEEN)).select(F.col("at")[0].alias("repo"), F.col("at")[1].alias("folder"), *held.columns[1:]))
    bare = asked.join(shuffled(held.select("repo", F.col("folder").alias("root"))), ["repo", "root"], "left_anti")
    up = upstream_projects(bare, paths, held.select("repo", F.col("folder").alias("path"))).select("repo", "root", "project_root", F.lit(True).alias("bare"))
    rows = asked.join(shuffled(up), ["repo", "root"], "left").withColumn("folder", F.coalesce("project_root", "root")).join(shuffled(held), ["repo", "folder"], "left")
    prefix = F.when(F.col("project_root") == ".", F.col("root")).otherwise(F.expr("substring(root, length(project_root) + 2)"))
    inside = F.concat("prefix", F.lit("/"))

    def seen(column: str) -> Column:
        """The paths of a list that are below the served folder, as seen from it."""
        near = F.filter(column, lambda x: (x["path"] == F.col("prefix")) | x["path"].startswith(inside))
        cut = F.transform(near, lambda x: F.struct(F.when(x["path"] == F.col("prefix"), ".").otherwise(F.substr(x["path"], F.length("prefix") + 2)).alias("path"), x["text"].alias("text")))
        return F.when(F.col("project_root").isNull(), F.col(column)).otherwise(cut)

    def pairs(column: Column, first: str, second: str) -> Column:
        kind = f"array<struct<{first}:string,{second}:string>>"
        return F.coalesce(column.cast(kind), F.array().cast(kind))

    served = base_name(F.when(F.col("root") == ".", F.col("repo")).otherwise(F.col("root")))
    no_values = F.array().cast("array<string>")
    elsewhere = F.when(F.col("project_root").isNotNull(), F.filter("important", lambda x: ~x["path"].startswith(inside)))
    return rows.withColumn("prefix", prefix).select(
        "repo", "root", F.coalesce("project_name", served).alias("project_name"),
        F.coalesce("tech", no_values).alias("tech"), F.coalesce("feature", no_values).alias("features"),
        pairs(seen("entry"), "path", "label").alias("entry_points"), pairs(seen("important"), "path", "reason").alias("important_files"), pairs(F.col("script"), "name", "command").alias("scripts"),
        "project_root", pairs(elsewhere, "path", "reason").alias("workspace_files"),
        F.when(F.col("project_root").isNotNull(), "upstream").when(F.col("bare"), "no_project").alias("warning"),
    )


#: Files that configure containers.
DOCKER = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
#: Fixed values: (label, message where it is found, message where it is not), in the order of the report.
FILE_CHECKS = [
    ("README.md", "Provides project background and usage", "Not found"),
    ("package.json", "Provides Node.js project metadata", "Not found"),
    ("tests", "Test directory or test files detected", "No test directory or test files detected"),
    ("GitHub Actions", "CI workflow detected", "No CI workflow detected"),
    ("Docker", "Docker configuration detected", "No Docker configuration detected"),
]
#: The keys of a configuration and the types of their values.
CONFIG_KEYS = {"maxDepth": "count", "ignore": "strings", "includeTests": "BOOLEAN", "includeScripts": "BOOLEAN", "includeCi": "BOOLEAN", "includeDocker": "BOOLEAN"}


def config_errors(value: Column) -> Column:
    """The keys of a parsed configuration whose values have a wrong type; a dot where it is no object; null where it is none."""
    def bad(key: str, kind: str) -> Column:
        held = F.try_variant_get(value, f"$.{key}", "variant")
        is_a = F.schema_of_variant(held)
        if kind == "count":
            number = F.try_variant_get(held, "$", "double")
            fits = (is_a.startswith("BIGINT") | is_a.startswith("DECIMAL") | is_a.startswith("DOUBLE")) & (number > 0) & (number == F.floor(number))
        elif kind == "strings":
            fits = is_a.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.coalesce(F.try_variant_get(held, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) != "STRING")
        else:
            fits = is_a == kind
        return F.when(held.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.lit(key))

    wrong = F.array_compact(F.array(*(bad(key, kind) for key, kind in CONFIG_KEYS.items())))
    return F.when(value.isNotNull(), F.when(F.schema_of_variant(value).startswith("OBJECT"), wrong).otherwise(F.array(F.lit("."))))


def doctor_report(repos: DataFrame, files: DataFrame, contents: DataFrame, config_name: str = "cairn.config.json") -> DataFrame:
    """(repo, place, label, status, message) of the seven checks of every repository asked for.

    status is pass, warning or fail. A repository without a file is not there: its target path fails, its files are missed.
    With a configuration of wrong types the config check fails, naming the keys, and the checks of files are not made; one
    that cannot be parsed counts as absent, as no configuration is one. Folders are known by the files below them. Each check
    is a flag of an aggregate over paths, so no list of a repository is gathered.
    """
    asked = with_repo(repos).select("repo").distinct()
    path = F.col("path")
    flags = [path == "README.md", path == "package.json", path.rlike(r"(^|/)tests/") | path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$"), path.rlike(r"^\.github/workflows/.+\.ya?ml$"), path.isin(DOCKER)]
    there = with_repo(files).filter("path is not null").groupBy("repo").agg(F.lit(True).alias("there"), *(F.bool_or(flag).alias(f"c{k}") for k, flag in enumerate(flags)))
    configs = with_repo(contents).filter(path == config_name).groupBy("repo").agg(F.min("content").alias("content"))
    wrong = configs.select("repo", config_errors(json_of(F.col("content"))).alias("wrong"))
    rows = asked.join(shuffled(there), "repo", "left").join(shuffled(wrong), "repo", "left")
    fine = F.coalesce(F.size("wrong"), F.lit(0)) <= 0

    def check(place: int, label: str, good: Column, other: str, message: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), F.when(good, "pass").otherwise(other).alias("status"), message.alias("message"))

    first = [
        check(1, "target path", F.col("there"), "fail", F.when(F.col("there"), "Path exists and is readable").otherwise(F.concat(F.lit("Path does not exist: "), "repo"))),
        check(2, "config", fine, "fail", F.when(fine, "Config file is valid").otherwise(F.concat(F.lit("Config file error: "), F.array_join("wrong", ", ")))),
    ]
    rest = [check(k + 3, label, F.col(f"c{k}"), "warning", F.when(F.col(f"c{k}"), yes).otherwise(no)) for k, (label, yes, no) in enumerate(FILE_CHECKS)]
    return rows.select("repo", F.inline(F.when(fine, F.array(*first, *rest)).otherwise(F.array(*first))))


def doctor_summary(report: DataFrame) -> DataFrame:
    """(repo, passed, warnings, failed): how many checks of each repository had which status."""
    counts = [F.count_if(F.col("status") == status).cast("int").alias(name) for status, name in (("pass", "passed"), ("warning", "warnings"), ("fail", "failed"))]
    return report.groupBy("repo").agg(*counts)
