"""Technologies, features, entry points and important files of repositories, by a rule table.

Files are (repo, path), contents (repo, path, content) of manifests. Paths give facts (repo, kind, arg) in one pass; the texts
that rules look at are stored, once parsed and once as they are, and give theirs from there. Facts join the small rule table,
and what they give is made distinct. A folder is known by a file below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.storage import materialise, shuffled
from cairn.sources.manifests import packages, workspace_packages

#: Names of dependencies and what they stand for, with the feature that they imply or None.
NODE = {
    "typescript": ("TypeScript", None), "react": ("React", "Frontend"), "vite": ("Vite", "Frontend"), "next": ("Next.js", "Frontend"), "vue": ("Vue", "Frontend"),
    "@vitejs/plugin-vue": ("Vue", "Frontend"), "express": ("Express", "Backend"), "@nestjs/core": ("NestJS", "Backend"), "@nestjs/common": ("NestJS", "Backend"),
    "fastify": ("Fastify", "Backend"), "prisma": ("Prisma", "Database"), "@prisma/client": ("Prisma", "Database"), "pg": ("PostgreSQL", "Database"),
    "mysql2": ("MySQL", "Database"), "sqlite3": ("SQLite", "Database"), "vitest": ("Vitest", None), "jest": ("Jest", None), "eslint": ("ESLint", None), "prettier": ("Prettier", None),
}
CARGO = {
    "actix-web": ("Actix Web", "Backend"), "axum": ("Axum", "Backend"), "rocket": ("Rocket", "Backend"), "warp": ("Warp", "Backend"), "tokio": ("Tokio", None),
    "serde": ("Serde", None), "diesel": ("Diesel", None), "sqlx": ("SQLx", None), "clap": ("Clap", "CLI application"), "tonic": ("Tonic (gRPC)", None),
}
#: Substrings of a manifest and what they stand for.
GO = {
    "github.com/gin-gonic/gin": ("Gin", "Backend"), "github.com/gofiber/fiber": ("Fiber", "Backend"), "github.com/labstack/echo": ("Echo", "Backend"),
    "github.com/gorilla/mux": ("Gorilla Mux", "Backend"), "google.golang.org/grpc": ("gRPC", None), "gorm.io/gorm": ("GORM", None), "github.com/jmoiron/sqlx": ("sqlx", None),
}
MAVEN = {
    "spring-boot": ("Spring Boot", "Backend"), "spring-cloud": ("Spring Cloud", None), "quarkus": ("Quarkus", "Backend"), "micronaut": ("Micronaut", "Backend"),
    "hibernate": ("Hibernate", None), "mybatis": ("MyBatis", None), "junit": (None, "Tests"), "testng": (None, "Tests"),
}
GRADLE = {
    "spring-boot": ("Spring Boot", "Backend"), "org.springframework.boot": ("Spring Boot", "Backend"), "quarkus": ("Quarkus", "Backend"), "ktor": ("Ktor", "Backend"),
    "android": ("Android", "Mobile"), "compose": ("Jetpack Compose", None),
}
SCHEMA = {'provider = "postgresql"': ("PostgreSQL", None), 'provider = "mysql"': ("MySQL", None), 'provider = "sqlite"': ("SQLite", None)}
#: Fixed values: (pattern of a path, what it gives as (output, value), what must hold besides). `gate` is for other rules alone.
PATHS = [
    (r"^tsconfig\.json$", [("tech", "TypeScript")], "node"),
    (r"^vite\.config", [("tech", "Vite"), ("feature", "Frontend")], None),
    (r"^next\.config", [("tech", "Next.js"), ("feature", "Frontend")], None),
    (r"^frontend/", [("feature", "Frontend"), ("feature", "Monorepo structure")], None),
    (r"^backend/", [("feature", "Backend"), ("feature", "Monorepo structure")], None),
    (r"^packages/", [("feature", "Monorepo structure")], None),
    (r"^prisma/schema\.prisma$", [("tech", "Prisma"), ("feature", "Database")], None),
    (r"^(Dockerfile|(docker-)?compose\.ya?ml)$", [("tech", "Docker"), ("feature", "Docker")], None),
    (r"^\.github/workflows/.+\.ya?ml$", [("tech", "GitHub Actions")], None),
    (r"\.py$|^pyproject\.toml$|^requirements.*\.txt$|^setup\.py$", [("gate", "python"), ("tech", "Python")], None),
    (r"^Pipfile$", [("tech", "Pipenv")], "python"),
    (r"^poetry\.lock$", [("tech", "Poetry")], "python"),
    (r"^manage\.py$|/settings\.py$", [("tech", "Django"), ("feature", "Backend")], "python"),
    (r"^(setup\.py|setup\.cfg|pyproject\.toml)$", [("feature", "Python package")], "python"),
    (r"^tests?/|^test_|/test_", [("feature", "Tests")], "python"),
    (r"\.go$|^go\.mod$", [("gate", "go"), ("tech", "Go")], None),
    (r"^internal/", [("feature", "Go internal packages")], "go"),
    (r"^pkg/", [("feature", "Go public packages")], "go"),
    (r"\.rs$|^Cargo\.toml$", [("tech", "Rust")], None),
    (r"\.java$", [("gate", "java"), ("tech", "Java")], None),
    (r"\.kts?$", [("gate", "java"), ("tech", "Kotlin")], None),
    (r"^pom\.xml$", [("gate", "java"), ("tech", "Maven")], None),
    (r"^build\.gradle(\.kts)?$", [("gate", "java"), ("tech", "Gradle")], None),
    (r"^settings\.gradle(\.kts)?$", [("feature", "Multi-module project")], "java"),
    (r"src/main/(java|kotlin)/", [("feature", "Standard Maven/Gradle layout")], "java"),
]
#: Entry points, by path.
ENTRIES = ["src/main.tsx", "src/main.ts", "src/cli.ts", "src/index.ts", "src/server.ts", "src/app.ts"]
#: Sections of a pyproject file and the tool that each belongs to, the first that is there counts.
TOOLS = {"poetry": "Poetry", "hatch": "Hatch", "pdm": "PDM", "uv": "uv"}


#: Manifests at the top that rules look at; package.json and Prisma's schema may stand deeper.
MANIFESTS = ["package.json", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Cargo.toml", "pyproject.toml", "pnpm-workspace.yaml"]


def rule_rows() -> list[tuple]:
    """(kind, arg, output, value, gate): a fact of that kind and arg gives the value, if the gate holds."""
    rows = [("path", pattern, output, value, gate) for pattern, given, gate in PATHS for output, value in given]
    for kind, table in (("node", NODE), ("cargo", CARGO), ("go", GO), ("maven", MAVEN), ("gradle", GRADLE), ("schema", SCHEMA)):
        rows += [(kind, arg, output, value, None) for arg, pair in table.items() for output, value in zip(("tech", "feature"), pair) if value]
    rows += [("file", path, "entry", path, "node") for path in ENTRIES]
    rows += [("tool", tool, "tech", name, None) for tool, name in TOOLS.items()]
    rows += [("hint", "node", "gate", "node", None), ("hint", "node", "feature", "Node.js package", None), ("hint", "workspace", "tech", "Monorepo", None), ("hint", "workspace", "feature", "Monorepo structure", None), ("hint", "cargo", "feature", "Cargo workspace", None), ("schema", "", "tech", "Prisma", None), ("schema", "", "feature", "Database", None)]
    return rows


def facts_where(kind: str, tests: dict[str, Column]) -> Column:
    """The facts of a kind whose test holds."""
    return F.filter(F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(arg).alias("arg"))) for arg, test in tests.items())), lambda x: x.isNotNull())


def section(text: Column, name: str) -> Column:
    """The lines of a TOML section, up to the next one; empty if it is not there."""
    return F.regexp_extract(text, rf"(?m)^\[{name}\][^\n]*\n((?:(?!\[)[^\n]*(?:\n|\z))*+)", 1)


def facts(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(repo, kind, arg): what paths and manifests tell."""
    path, text, none = F.col("path"), F.col("content"), F.array().cast("array<struct<kind:string,arg:string>>")
    of_paths = files.select("repo", F.explode(F.concat(facts_where("path", {p: path.rlike(p) for p, _, _ in PATHS}), facts_where("file", {p: path == p for p in ENTRIES}))).alias("f"))
    contents = materialise(contents.filter(path.isin(MANIFESTS) | path.endswith("/package.json") | path.endswith("prisma/schema.prisma")).select("repo", "path", "content"))
    found = materialise(packages(contents))
    members = materialise(workspace_packages(found))
    used = found.filter("path = 'package.json'").unionByName(members)
    names = used.select("repo", F.explode(F.array_union(F.map_keys("dependencies"), F.map_keys("dev_dependencies"))).alias("arg"))
    of_packages = names.select("repo", F.struct(F.lit("node").alias("kind"), "arg").alias("f"))
    hints = found.filter("path = 'package.json'").select("repo", F.explode(facts_where("hint", {"node": F.lit(True), "workspace": F.size("workspaces") > 0})).alias("f"))
    gradle = contents.filter("path in ('build.gradle', 'build.gradle.kts')").groupBy("repo").agg(F.max_by("content", "path").alias("content")).withColumn("path", F.lit("build.gradle"))
    needles = F.lit(None).cast("array<struct<kind:string,arg:string>>")
    for name, kind, table in (("go.mod", "go", GO), ("pom.xml", "maven", MAVEN), ("build.gradle", "gradle", GRADLE)):
        needles = F.when(path == name, facts_where(kind, {arg: F.contains(text, F.lit(arg)) for arg in table})).otherwise(needles)
    cargo = F.concat_ws("\n", section(text, "dependencies"), section(text, "dev-dependencies"))
    named = {arg: cargo.rlike(rf'(?m)^\s*"?{arg}"?\s*[.=]') | text.rlike(rf"(?m)^\[(dev-)?dependencies\.{arg}\]") for arg in CARGO}
    members_of = section(text, "workspace").rlike(r"(?m)^\s*members\s*=\s*\[\s*[\"']")
    needles = F.when(path == "Cargo.toml", F.concat(facts_where("cargo", named), facts_where("hint", {"cargo": text.rlike(r"(?m)^\[workspace[\].]"), "workspace": members_of}))).otherwise(needles)
    tool = {}
    for name in TOOLS:
        here = text.rlike(rf"(?m)^\[+tool\.{name}[\].]")
        tool[name] = here if not tool else here & ~before
        before = here if len(tool) == 1 else before | here
    needles = F.when(path == "pyproject.toml", facts_where("tool", tool)).otherwise(needles)
    needles = F.when(path == "pnpm-workspace.yaml", facts_where("hint", {"workspace": text.rlike(r"(?m)^packages:[ \t]*(\r?\n[ \t]*-[ \t]*\S|\[\s*['\"])")})).otherwise(needles)
    texts = contents.filter("path not in ('build.gradle', 'build.gradle.kts') and content is not null").select("repo", "path", "content").unionByName(gradle.select("repo", "path", "content"))
    of_texts = texts.select("repo", F.explode(F.coalesce(needles, none)).alias("f"))
    homes = members.select("repo", F.regexp_replace("path", r"/package\.json$", "/prisma/schema.prisma").alias("path")).distinct()
    schemas = contents.filter(path.endswith("prisma/schema.prisma")).select("repo", "path", "content")
    schemas = schemas.filter("path = 'prisma/schema.prisma'").unionByName(schemas.join(shuffled(homes), ["repo", "path"], "left_semi").select("repo", "path", "content"))
    of_schemas = schemas.select("repo", F.explode(facts_where("schema", {"": F.lit(True)} | {arg: F.contains(text, F.lit(arg)) for arg in SCHEMA})).alias("f"))
    every = of_paths.unionByName(of_packages.filter(F.col("f.arg").isin(list(NODE)))).unionByName(hints).unionByName(of_texts).unionByName(of_schemas)
    return every.select("repo", "f.kind", "f.arg").distinct()


def detect(files: DataFrame, contents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repo, output, value): tech, feature and entry values, each once; CI features are named by their workflow.

    known, where given, is what facts found of the same tables.
    """
    rules = files.sparkSession.createDataFrame(rule_rows(), "kind string, arg string, output string, value string, gate string")
    hits = (facts(files, contents) if known is None else known).join(F.broadcast(rules), ["kind", "arg"]).select("repo", "output", "value", "gate").distinct()
    hits = materialise(hits)
    open_gates = hits.filter("output = 'gate'").select("repo", F.col("value").alias("gate"), F.lit(True).alias("open")).distinct()
    kept = hits.filter("output <> 'gate'").join(shuffled(open_gates), ["repo", "gate"], "left").filter("gate is null or open").select("repo", "output", "value")
    flows = contents.filter(F.col("path").rlike(r"^\.github/workflows/.+\.ya?ml$"))
    named = flows.select("repo", F.regexp_extract("content", r"(?m)^name:[ \t]*['\"]?([^\r\n]*?)['\"]?[ \t]*\r?$", 1).alias("name"))
    labels = named.filter("name <> ''").select("repo", F.lit("feature").alias("output"), F.concat(F.lit("CI: "), "name").alias("value"))
    unnamed = files.filter(F.col("path").rlike(r"^\.github/workflows/.+\.ya?ml$")).select("repo").distinct().join(shuffled(labels.select("repo")), "repo", "left_anti")
    return kept.unionByName(labels).unionByName(unnamed.select("repo", F.lit("feature").alias("output"), F.lit("CI").alias("value"))).distinct()
