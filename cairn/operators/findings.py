"""Entry points with labels, important files with reasons, scripts and names of repositories.

Files are (repo, path), contents (repo, path, content) of manifests. Paths meet a table of rules; what a rule gives has the
rule's place, and the first that names a path, or a script, wins. Rules of a detector count only where the detector does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.paths import in_locale_order
from cairn.operators.detect import ENTRIES, NODE, PATHS, facts, section
from cairn.operators.storage import materialise, shuffled
from cairn.sources.manifests import json_text, packages, workspace_packages

MAIN, SERVER, MONOREPO = "Application entry point", "Server entry point", "Monorepo workspace configuration"
COMPOSE, CONFIG, TASKS = "Container orchestration config", "Application configuration", "Build and task automation"
#: Fixed values, in the order in which they count: (gate, output, most of a repository, [(path, what it is)]).
NAMED = [
    ("node", "entry", None, list(zip(ENTRIES, ["Frontend app entry", "App entry point", "CLI entry point", "Node.js entry point", SERVER, "App bootstrap entry"]))),
    ("node", "important", None, [("package.json", "Project metadata, scripts and dependency declarations")]),
    ("frontend", "entry", None, [("src/main.tsx", "React/Vite frontend entry"), ("src/main.ts", "Frontend entry point"), ("frontend/src/main.tsx", "Monorepo frontend entry"), ("frontend/src/main.ts", "Monorepo frontend entry")]),
    ("frontend", "important", 1, "vite"),
    ("backend", "entry", None, [("src/server.ts", SERVER), ("src/index.ts", SERVER), ("backend/src/server.ts", "Monorepo backend entry"), ("backend/src/index.ts", "Monorepo backend entry")]),
    (None, "important", None, "schema"),
    (None, "important", None, [("Dockerfile", "Container image build config"), ("docker-compose.yml", COMPOSE), ("docker-compose.yaml", COMPOSE), ("compose.yml", COMPOSE), ("compose.yaml", COMPOSE)]),
    (None, "important", None, "workflow"),
    ("monorepo", "important", None, [("package.json", MONOREPO), ("pnpm-workspace.yaml", MONOREPO), ("turbo.json", MONOREPO), ("nx.json", MONOREPO), ("Cargo.toml", MONOREPO)]),
    ("python", "important", None, [("pyproject.toml", "Python project configuration")]),
    ("python", "important", 1, "requirements"),
    ("python", "important", None, [("setup.py", "Python package setup")]),
    ("python", "entry", None, [("manage.py", "Django management entry")]),
    ("python", "entry", 1, "app"),
    ("go", "important", None, [("go.mod", "Go module definition and dependencies"), ("go.sum", "Go dependency checksums"), ("Makefile", TASKS)]),
    ("go", "entry", None, [("main.go", "Go main entry point"), ("cmd/main.go", "Go main entry point")]),
    ("go", "entry", 1, "binary"),
    ("rust", "important", None, [("Cargo.toml", "Rust package manifest and dependencies"), ("Cargo.lock", "Rust dependency lock file"), ("build.rs", "Rust build script")]),
    ("rust", "important", 1, [("Makefile", TASKS), ("Makefile.toml", TASKS)]),
    ("rust", "entry", None, [("src/main.rs", "Rust binary entry point"), ("src/lib.rs", "Rust library entry point")]),
    ("rust", "entry", 5, "crate"),
    ("java", "important", None, [("pom.xml", "Maven project configuration")]),
    ("java", "important", 1, [("build.gradle.kts", "Gradle build configuration"), ("build.gradle", "Gradle build configuration")]),
    ("java", "important", 1, [("settings.gradle.kts", "Gradle multi-project settings"), ("settings.gradle", "Gradle multi-project settings")]),
    ("java", "entry", 3, "main"),
    ("java", "important", 1, [("src/main/resources/application.yml", CONFIG), ("src/main/resources/application.yaml", CONFIG), ("src/main/resources/application.properties", CONFIG)]),
]
#: The rules above that are patterns: (pattern, what it is, with the pattern's first group after it).
SHAPES = {
    "vite": (r"^(?=vite\.config)()", "Vite build configuration"),
    "workflow": (r"^\.github/workflows/.+()\.ya?ml$", "GitHub Actions workflow"),
    "requirements": (r"^requirements.*()\.txt$", "Python dependencies"),
    "app": (r"^(?:src/)?(?:app|main)()\.py$", MAIN),
    "binary": (r"^cmd/([^/]+)/.*\.go$", "CLI binary: "),
    "crate": (r"^(.+?)/src/main\.rs$", "Workspace binary: "),
    "main": (r"(?:Application|Main)()\.(?:java|kt)$", MAIN),
}
#: The one shape whose rows are limited within each value of its group; the others are limited within a repository.
BY_GROUP = "binary"
SCHEMA_REASON = "Prisma data model and database connection config"
MOST = max(limit or 0 for _, _, limit, _ in NAMED)


def gate_rows() -> list[tuple]:
    """(kind, arg, gate): facts that open a detector's rules."""
    rows = [("hint", "node", "node"), ("hint", "workspace", "monorepo")]
    for gate, value in (("frontend", "Frontend"), ("backend", "Backend"), ("monorepo", "Monorepo structure"), ("rust", "Rust")):
        rows += [("path", pattern, gate) for pattern, given, needs in PATHS if needs is None and value in (v for _, v in given)]
        rows += [("node", name, gate) for name, (_, feature) in NODE.items() if feature == value]
    return rows + [("path", pattern, value) for pattern, given, _ in PATHS for output, value in given if output == "gate"]


def rule_rows() -> list[tuple]:
    """(path, rule, nth, text): the rules that name a path."""
    return [(path, rule, nth, text) for rule, (_, _, _, held) in enumerate(NAMED) if isinstance(held, list) for nth, (path, text) in enumerate(held)]


def candidates(files: DataFrame) -> DataFrame:
    """(repo, rule, nth, seen, group, path, text): what rules say of paths; seen is the path in the scan."""
    path, named = F.col("path"), files.sparkSession.createDataFrame(rule_rows(), "path string, rule int, nth int, text string")
    by_name = files.join(F.broadcast(named), "path").select("repo", "rule", "nth", path.alias("seen"), F.lit("").alias("group"), "path", "text")

    def shape(rule: int, name: str) -> Column:
        pattern, text = SHAPES[name]
        group = F.regexp_extract(path, pattern, 1)
        given = F.lit("requirements.txt") if name == "requirements" else path
        hit = path.rlike(pattern) if name != "crate" else path.rlike(pattern) & (path != "src/main.rs")
        return F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("nth"), path.alias("seen"), group.alias("group"), given.alias("path"), F.concat(F.lit(text), group).alias("text")))

    shapes = F.filter(F.array(*(shape(rule, held) for rule, (_, _, _, held) in enumerate(NAMED) if not isinstance(held, list) and held in SHAPES)), lambda x: x.isNotNull())
    return by_name.unionByName(files.select("repo", F.explode(shapes).alias("x")).select("repo", "x.*"))


def schemas(files: DataFrame, found: DataFrame) -> DataFrame:
    """Prisma's schemas at the top and in workspace packages, as candidates."""
    manifests = files.filter((F.col("path") == "package.json") | F.col("path").endswith("/package.json"))
    members = workspace_packages(manifests.join(shuffled(found.select("repo", "path", "workspaces")), ["repo", "path"], "left"))
    homes = members.select("repo", F.regexp_replace("path", r"/package\.json$", "/prisma/schema.prisma").alias("path"))
    rows = files.filter(F.col("path").endswith("prisma/schema.prisma"))
    rows = rows.filter("path = 'prisma/schema.prisma'").unionByName(rows.join(shuffled(homes), ["repo", "path"], "left_semi").select(*rows.columns))
    rule = next(k for k, held in enumerate(NAMED) if held[3] == "schema")
    return rows.distinct().select("repo", F.lit(rule).alias("rule"), F.lit(0).alias("nth"), F.col("path").alias("seen"), F.lit("").alias("group"), "path", F.lit(SCHEMA_REASON).alias("text"))


def node_scripts(contents: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, part, nth, path, text) of the top package's scripts whose commands are strings, in the order of the file."""
    keys = F.json_object_keys(F.get_json_object(json_text(F.col("content")), "$.scripts"))
    order = contents.filter("path = 'package.json'").select("repo", keys.alias("keys"))
    rows = found.filter("path = 'package.json'").join(shuffled(order), "repo").select("repo", "keys", F.explode("scripts").alias("path", "text"))
    return rows.select("repo", F.lit(0).alias("part"), F.array_position("keys", F.col("path")).cast("int").alias("nth"), "path", "text")


def python_scripts(contents: DataFrame) -> DataFrame:
    """The same of the section project.scripts of a pyproject file, by pattern: one name and one string to a line."""
    line = r"""(?m)^[ \t]*["']?([^"'\s=]+)["']?[ \t]*=[ \t]*(?:"([^"\n]*)"|'([^'\n]*)')"""
    lines = section(F.col("content"), r"[ \t]*project\.scripts[ \t]*")
    both = F.zip_with(F.regexp_extract_all(lines, F.lit(line), 1), F.zip_with(F.regexp_extract_all(lines, F.lit(line), 2), F.regexp_extract_all(lines, F.lit(line), 3), lambda a, b: F.concat(a, b)), lambda n, c: F.struct(n.alias("path"), c.alias("text")))
    rows = contents.filter("path = 'pyproject.toml'").select("repo", F.posexplode(both).alias("nth", "x"))
    return rows.select("repo", F.lit(1).alias("part"), "nth", "x.path", "x.text")


def findings(files: DataFrame, contents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repo, output, place, path, text): `entry` paths with labels, `important` paths with reasons, `script` names with
    commands, from place 1 on, and `name`, whose text is the project's.

    known, where given, is what detect.facts found of the same tables. Repeated rows count once; null paths do not count; a
    manifest that cannot be read counts as absent, and of unlike contents of one path the least counts. Paths are compared by their bytes, folders below cmd by language rules.
    """
    files = files.filter("path is not null").select("repo", "path").distinct()
    known = facts(files, contents) if known is None else known
    tops = contents.filter("path in ('package.json', 'pyproject.toml') and content is not null")
    contents = materialise(tops.groupBy("repo", "path").agg(F.min("content").alias("content")))
    found = materialise(packages(contents))
    session = files.sparkSession
    gates = session.createDataFrame(gate_rows(), "kind string, arg string, gate string")
    is_open = known.join(F.broadcast(gates), ["kind", "arg"]).select("repo", "gate").distinct()
    rules = session.createDataFrame([(k, gate, output, limit, held == BY_GROUP) for k, (gate, output, limit, held) in enumerate(NAMED)], "rule int, gate string, output string, most int, by_group boolean")
    given = candidates(files).unionByName(schemas(files, found)).join(F.broadcast(rules), "rule")
    given = materialise(given.join(shuffled(is_open.withColumn("open", F.lit(True))), ["repo", "gate"], "left").filter("gate is null or open").drop("gate", "open"))
    within = Window.partitionBy("repo", "rule", F.when(F.col("by_group"), F.col("group"))).orderBy("nth", "seen")
    few = given.filter("most is not null").withColumn("k", F.row_number().over(within)).filter(f"k <= {MOST} and k <= most").drop("k")
    rank = F.struct("rule", "nth", F.when(F.col("by_group"), in_locale_order(F.col("group"))).alias("group"), "seen").alias("rank")
    kept = given.filter("most is null").unionByName(few).select("repo", "output", "path", "text", rank)
    scripts = node_scripts(contents, found).unionByName(python_scripts(contents))
    scripts = scripts.select("repo", F.lit("script").alias("output"), "path", "text", F.struct(F.col("part").alias("rule"), "nth", in_locale_order(F.lit(None).cast("string")).alias("group"), F.lit("").alias("seen")).alias("rank"))
    once = kept.unionByName(scripts).groupBy("repo", "output", "path").agg(F.min_by("text", "rank").alias("text"), F.min("rank").alias("rank"))
    placed = once.select("repo", "output", F.row_number().over(Window.partitionBy("repo", "output").orderBy("rank")).alias("place"), "path", "text")
    names = found.filter("path = 'package.json' and name is not null").select("repo", F.lit("name").alias("output"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("path"), F.col("name").alias("text"))
    return placed.unionByName(names)
