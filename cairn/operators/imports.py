"""Import edges of TypeScript and JavaScript, Python and Go sources.

Contents are (path, content) rows, files (path) rows, both with `repo` where there are several repositories: nothing is
resolved across them. An edge is (repo, src, dst, specifiers, lang, ordinal); each target of a file appears once, with the
specifiers and the place of the first statement that leads to it. Null contents have no imports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import base_name, directory
from cairn.operators.facts import PYTHON_MODULES, SCRIPT_EXTENSIONS, source_facts
from cairn.operators.resolve import representatives
from cairn.operators.storage import materialise, shuffled

#: What a written extension may stand for.
WRITTEN_FOR = {".js": [".ts", ".tsx"], ".jsx": [".tsx", ".ts"], ".mjs": [".mts", ".ts", ".tsx"], ".cjs": [".cts", ".ts", ".tsx"]}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def with_repo(rows: DataFrame) -> DataFrame:
    """rows, of one nameless repository where they name none."""
    return rows if "repo" in rows.columns else rows.withColumn("repo", F.lit(""))


def joined(folder: Column, rest: Column) -> Column:
    """The path of rest as seen from folder, without dots; a final slash stays."""
    whole = F.concat_ws("/", folder, rest)
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))

    def step(acc, x):
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))

    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    path = F.when(rest.endswith("/"), F.concat(path, F.lit("/"))).otherwise(path)
    # one replacement takes the dots out of most paths; where some are left, the segments are gone through one by one
    short = F.regexp_replace(whole, r"(?<![^/])(?:\.?/|(?!\.\.?/)[^/]+/\.\./)", "")
    return F.when(~short.rlike(r"(^|/)\.{0,2}(/|$)"), short).otherwise(path)


def script_candidates(path: Column) -> Column:
    """The paths that a relative module may mean, best first."""
    swapped = F.array().cast("array<string>")
    for written, meant in WRITTEN_FOR.items():
        named = path.rlike(rf"[^/]\{written}$")
        swapped = F.when(named, F.array(*(F.concat(F.substring(path, F.lit(1), F.length(path) - len(written)), F.lit(e)) for e in meant))).otherwise(swapped)
    endings = F.array(*map(F.lit, SCRIPT_EXTENSIONS), *(F.lit("/index" + e) for e in SCRIPT_EXTENSIONS))
    return F.concat(F.array(path), swapped, F.transform(endings, lambda e: F.concat(path, e)))


def script_rank(target: Column, path: Column) -> Column:
    """The place of path, from 1, among the script_candidates of target, which are not made for it; 0 if it is none of them."""
    found, swapped = F.lit(0).cast("bigint"), F.lit(0)
    for written, meant in WRITTEN_FOR.items():
        cut = F.length(target) - len(written)
        rest = F.when(F.substring(path, F.lit(1), cut) == F.substring(target, F.lit(1), cut), F.substring(path, cut + 1, F.length(path)))
        named = target.rlike(rf"[^/]\{written}$")
        found = F.when(named, F.coalesce(F.array_position(F.array(*map(F.lit, meant)), rest), F.lit(0))).otherwise(found)
        swapped = F.when(named, F.lit(len(meant))).otherwise(swapped)
    endings = F.array(*map(F.lit, SCRIPT_EXTENSIONS), *(F.lit("/index" + e) for e in SCRIPT_EXTENSIONS))
    ending = F.when(path.startswith(target), F.array_position(endings, F.substring(path, F.length(target) + 1, F.length(path))))
    return F.when(path == target, F.lit(1)).when(found > 0, found + 1).when(ending > 0, ending + 1 + swapped).otherwise(0)


def specifiers(names: Column) -> Column:
    """Names between braces, without `type`; a bare name alone; none if empty."""
    inner = F.transform(F.split(F.regexp_replace(names, r"[{}]", ""), ","), lambda x: F.regexp_replace(stripped(x), r"^type\s+", ""))
    return F.filter(inner, lambda x: x != "")


def imported_names(text: Column, kept: str = r"^[A-Za-z_]\w*$") -> Column:
    """Identifiers of a comma list, without `as`."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[()]", ""), ","), lambda x: F.regexp_replace(stripped(x), r"\s+as\s+\w+$", ""))
    return F.filter(parts, lambda x: x.rlike(kept))


def script_stem(path: Column) -> Column:
    """A path without the extension of a script."""
    return F.regexp_replace(path, r"\.[cm]?[jt]s$|\.[jt]sx$", "")


def script_hits(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of found (repo, src, ordinal, specifiers, target) with each path that the target may mean, and its rank.

    A candidate's stem is the target, its stem, or the target's index, so both sides meet under these two or three keys
    instead of under every candidate.
    """
    stem = script_stem(F.col("path"))
    homes = F.when(stem.endswith("/index") & (stem != F.col("path")), F.array(stem, F.regexp_replace(stem, "/index$", ""))).otherwise(F.array(stem))
    there = with_repo(files).select("repo", "path", F.explode(homes).alias("key"))
    asked = found.select("*", F.explode(F.array_distinct(F.array(script_stem(F.col("target")), "target"))).alias("key"))
    rank = script_rank(F.col("target"), F.col("path"))
    return asked.join(shuffled(there), ["repo", "key"]).withColumn("rank", rank).filter("rank > 0").drop("key", "target")


def candidate_hits(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of found (repo, src, ordinal, specifiers, candidates) with each candidate that is a file, and its rank."""
    tried = found.select("repo", "src", "ordinal", "specifiers", F.posexplode("candidates").alias("rank", "path"))
    return tried.join(shuffled(with_repo(files).select("repo", "path")), ["repo", "path"])


def first_per_target(hits: DataFrame, lang: str) -> DataFrame:
    """Edges of statements (repo, src, ordinal, specifiers) with the paths that they hit, by rank: the first for each target."""
    hits = hits.repartition("repo", "src")  # both steps group within a file
    best = hits.groupBy("repo", "src", "ordinal").agg(F.min_by(F.struct("path", "specifiers"), "rank").alias("t"))
    edges = best.groupBy("repo", "src", F.col("t.path").alias("dst")).agg(F.min_by("t.specifiers", "ordinal").alias("specifiers"), F.min("ordinal").alias("ordinal"))
    return edges.select("repo", "src", "dst", F.coalesce("specifiers", F.array().cast("array<string>")).alias("specifiers"), F.lit(lang).alias("lang"), "ordinal")


def ordinal(pos: Column | str = "pos", k: Column | str | None = None) -> Column:
    """The place of a statement among those of its file: by pattern, then by order."""
    return F.struct(F.col("rank").alias("pat"), (F.col(pos) if isinstance(pos, str) else pos).alias("pos"), (F.lit(0) if k is None else F.col(k)).alias("k")).alias("ordinal")


def script_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports and re-exports."""
    rows = facts.filter("fact = 'script'")
    names = F.when(F.col("g1").isNotNull(), specifiers(F.col("g1"))).otherwise(F.array().cast("array<string>"))
    target = joined(directory(F.col("path")), F.col("g2"))
    rows = rows.select("repo", F.col("path").alias("src"), ordinal(), names.alias("specifiers"), target.alias("target"))
    return first_per_target(script_hits(rows, files), "ts")


def python_module(path: Column) -> Column:
    """R2."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py"))))


def python_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Imports that start a line, names over several lines included; a file's edge to itself is left out."""
    rows = facts.filter("fact = 'python'").withColumn("src", F.col("path"))
    plain = rows.filter("rank = 0").select("repo", "src", "rank", "pos", F.posexplode(imported_names(F.regexp_replace("g1", r"[()]", " ( "), r"^[A-Za-z_][\w.]*$")).alias("k", "module"))
    plain = plain.select("repo", "src", ordinal(k="k"), F.array("module").alias("specifiers"), python_module(F.translate("module", ".", "/")).alias("candidates"))
    rows = rows.filter(F.col("rank").between(1, len(PYTHON_MODULES)))
    body = F.array_join(F.filter(F.transform(F.split("g2", "\n"), stripped), lambda x: x != ""), " ")
    rows = rows.withColumn("specifiers", imported_names(F.when(F.col("g4") != "", F.col("g4")).otherwise(F.concat(body, F.col("g3")))))
    dots = F.length(F.regexp_extract("g1", r"^\.*", 0))
    suffix = F.translate(F.expr("substring(g1, length(regexp_extract(g1, '^\\\\.*', 0)) + 1)"), ".", "/")
    own = F.split(F.when(directory(F.col("src")) == "", F.lit(".")).otherwise(directory(F.col("src"))), "/")
    package = F.when(dots > 0, F.array_join(F.slice(own, F.lit(1), F.greatest(F.lit(0), F.size(own) - dots + 1)), "/")).otherwise(F.lit(""))
    base = F.array_join(F.filter(F.array(package, suffix), lambda x: x != ""), "/")
    rows = rows.withColumn("base", base).withColumn("direct", F.when((dots > 0) & (suffix != ""), python_module(base)).otherwise(F.array().cast("array<string>")))
    inner = F.transform("specifiers", lambda n: python_module(F.when(F.col("base") == "", n).otherwise(F.concat(F.col("base"), F.lit("/"), n))))
    tried = F.concat("direct", F.flatten(inner), python_module(F.col("base")))
    found = rows.select("repo", "src", ordinal(), "specifiers", tried.alias("candidates"))
    return first_per_target(candidate_hits(plain.unionByName(found), with_repo(files).filter(F.col("path").endswith(".py"))), "py").filter("src <> dst")


def go_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Imports below the module that the repository's go.mod names, to each package's representative file."""
    module = facts.filter("fact = 'module' and path = 'go.mod'").select("repo", F.col("g1").alias("module"))
    sources = with_repo(files).filter(F.col("path").endswith(".go"))
    folder = directory(F.col("path"))
    group = F.struct(F.col("repo"), folder.alias("folder"))
    kept = representatives(sources, group, base_name(F.col("path")) == F.concat(base_name(folder), F.lit(".go")), F.col("path").endswith("_test.go"))
    kept = kept.select("grp.repo", "grp.folder", F.col("path").alias("dst"))
    rows = facts.filter("fact = 'go'").select("repo", F.col("path").alias("src"), ordinal().alias("ordinal"), F.col("g1").alias("name"))
    below = rows.join(shuffled(module), "repo").filter(F.col("name").startswith(F.concat("module", F.lit("/"))))
    below = below.withColumn("folder", F.expr("substring(name, length(module) + 2)"))
    edges = below.join(shuffled(kept), ["repo", "folder"]).filter("src <> dst")
    return edges.select("repo", "src", "dst", F.array("name").alias("specifiers"), F.lit("go").alias("lang"), "ordinal")


def edges_of(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The edges of all three languages, from facts that were taken in one pass."""
    return script_edges(facts, files).unionByName(python_edges(facts, files)).unionByName(go_edges(facts, files))


def import_edges(contents: DataFrame, files: DataFrame) -> DataFrame:
    """The edges of contents; the facts are stored between, so that each text is read once. Symbols and calls are not sought."""
    return edges_of(materialise(source_facts(contents, declared=False)), files)
