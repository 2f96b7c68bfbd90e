"""Package manifests of many repositories as tables (S5, P16, R9, G14). Contents are (repo, path, content) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.storage import shuffled

STRING = r'("(?:[^"\\]++|\\.)*+")'


def json_text(text: Column) -> Column:
    """JSON without its comments and trailing commas."""
    text = F.regexp_replace(text, STRING + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(text, STRING + r"|,(?=\s*[}\]])", "$1")


def json_of(text: Column) -> Column:
    """JSON with comments and trailing commas as a variant; null where it cannot be parsed."""
    return F.try_parse_json(json_text(text))


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def entries(value: Column, path: str) -> Column:
    """The entries of an object, as map<string,variant>; empty if there is none."""
    return F.coalesce(F.try_variant_get(value, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def strings(value: Column, path: str) -> Column:
    """The entries of an object whose values are strings."""
    kept = F.map_filter(entries(value, path), lambda k, v: is_string(v))
    return F.transform_values(kept, lambda k, v: F.variant_get(v, "$", "string"))


def string_list(value: Column, path: str) -> Column:
    """The strings of an array; null if it is no array."""
    kept = F.filter(F.try_variant_get(value, path, "array<variant>"), is_string)
    return F.transform(kept, lambda v: F.variant_get(v, "$", "string"))


def packages(contents: DataFrame) -> DataFrame:
    """(repo, path, name, dependencies, dev_dependencies, scripts, workspaces, all_names) of every readable package.json.

    all_names holds the names of all dependencies, of any value; a file that holds no object is left out.
    """
    rows = contents.filter((F.col("path") == "package.json") | F.col("path").endswith("/package.json"))
    rows = rows.select("repo", "path", json_of(F.col("content")).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    named = F.try_variant_get("v", "$.name", "variant")
    return rows.select(
        "repo", "path",
        F.when(is_string(named), F.variant_get(named, "$", "string")).alias("name"),
        strings(F.col("v"), "$.dependencies").alias("dependencies"),
        strings(F.col("v"), "$.devDependencies").alias("dev_dependencies"),
        strings(F.col("v"), "$.scripts").alias("scripts"),
        F.coalesce(string_list(F.col("v"), "$.workspaces"), string_list(F.col("v"), "$.workspaces.packages"), F.array().cast("array<string>")).alias("workspaces"),
        F.map_keys(entries(F.col("v"), "$.dependencies")).alias("names"),
        F.map_keys(entries(F.col("v"), "$.devDependencies")).alias("dev_names"),
    )


def workspace_packages(found: DataFrame) -> DataFrame:
    """The packages that their repository's root manifest names as workspaces, by path or by the part before a star."""
    root = found.filter("path = 'package.json'").select("repo", F.col("workspaces").alias("wanted"))

    def fits(wanted: Column) -> Column:
        wanted = F.regexp_replace(F.translate(wanted, "\\", "/"), "/$", "")
        prefix = F.regexp_replace(F.substring_index(wanted, "*", 1), "/$", "")
        below = (prefix != "") & F.col("path").startswith(F.concat(prefix, F.lit("/"))) & F.col("path").endswith("/package.json")
        return F.when(F.contains(wanted, F.lit("*")), below).otherwise(F.col("path") == F.concat(wanted, F.lit("/package.json")))

    return found.join(shuffled(root), "repo").filter(F.exists("wanted", fits)).drop("wanted")


def workspace_graph(found: DataFrame) -> DataFrame:
    """(repo, name, path, dependencies, dev_dependencies) of workspace packages, dependencies within the workspace only."""
    members = workspace_packages(found)
    members = members.withColumn("folder", F.regexp_replace("path", "/package.json", "")).withColumn("name", F.coalesce("name", "folder"))
    known = members.select("repo", F.col("name").alias("other")).distinct()

    def inside(column: str, out: str) -> DataFrame:
        rows = members.select("repo", "path", F.explode(column).alias("other")).join(shuffled(known), ["repo", "other"])
        return rows.groupBy("repo", "path").agg(F.array_sort(F.collect_set("other")).alias(out))  # one manifest's list

    none = F.array().cast("array<string>")
    out = members.join(shuffled(inside("names", "dependencies_in")), ["repo", "path"], "left").join(shuffled(inside("dev_names", "dev_in")), ["repo", "path"], "left")
    return out.select("repo", "name", F.col("folder").alias("path"), F.coalesce("dependencies_in", none).alias("dependencies"), F.coalesce("dev_in", none).alias("dev_dependencies"))
