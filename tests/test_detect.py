import json

from cairn.operators.detect import detect
from cairn.sources.manifests import packages, workspace_graph

FULLSTACK = {
    "package.json": json.dumps({"name": "root", "workspaces": ["frontend", "packages/*", "backend/"]}),
    "frontend/package.json": '{ // comment "x"\n "name": "frontend", "dependencies": {"react": "1", "@fixture/shared": "*", "url": "http://a",},\n "devDependencies": {"vite": "2", "jest": 3}}',
    "backend/package.json": json.dumps({"name": "backend", "dependencies": {"express": "1", "@fixture/shared": "*"}, "devDependencies": {"typescript": "5"}}),
    "packages/shared/package.json": json.dumps({"name": "@fixture/shared"}),
    "backend/prisma/schema.prisma": 'provider = "postgresql"',
}
NESTED = {"package.json": json.dumps({"name": "n", "dependencies": {"vitest": "1"}}), "tests/fixtures/a/package.json": json.dumps({"dependencies": {"prisma": "1"}}), "tests/fixtures/a/prisma/schema.prisma": 'provider = "mysql"', "tsconfig.json": "{}", "src/cli.ts": "", ".github/workflows/ci.yml": "name: Build\non: push\n"}
OTHERS = {"Cargo.toml": '[package]\nname = "x"\n[dependencies]\naxum = "1"\nserde = { version = "1" }\n[workspace]\nmembers = ["a"]\n', "pyproject.toml": "[tool.uv]\na = 1\n[tool.pdm]\n", "go.mod": "module x\nrequire github.com/gin-gonic/gin v1\n", "build.gradle": "quarkus", "build.gradle.kts": "ktor", "internal/a.go": "", "tsconfig.json": "{}", "package.json": "not json"}


def tables(spark, **repos):
    rows = [(repo, path, text) for repo, held in repos.items() for path, text in held.items()]
    contents = spark.createDataFrame(rows, "repo string, path string, content string")
    return contents.select("repo", "path"), contents


def test_rules(spark):
    found = {}
    for r in detect(*tables(spark, full=FULLSTACK, nested=NESTED, others=OTHERS)).collect():
        found.setdefault((r["repo"], r["output"]), set()).add(r["value"])
    assert found["full", "tech"] == {"Monorepo", "TypeScript", "React", "Vite", "Express", "Prisma", "PostgreSQL"}
    assert found["full", "feature"] == {"Node.js package", "Frontend", "Backend", "Database", "Monorepo structure"}
    assert found["nested", "tech"] == {"TypeScript", "Vitest", "GitHub Actions"}
    assert found["nested", "feature"] == {"Node.js package", "CI: Build"}
    assert found["nested", "entry"] == {"src/cli.ts"}
    assert {"Rust", "Axum", "Serde", "Python", "PDM", "Go", "Gin", "Gradle", "Ktor", "Kotlin", "Monorepo"} <= found["others", "tech"]
    assert not {"uv", "Quarkus"} & found["others", "tech"]
    assert {"Cargo workspace", "Go internal packages", "Backend", "Python package"} <= found["others", "feature"]


def test_workspaces(spark):
    _, contents = tables(spark, full=FULLSTACK, nested=NESTED, others=OTHERS)
    rows = {r["name"]: (r["path"], r["dependencies"], r["dev_dependencies"]) for r in workspace_graph(packages(contents)).collect()}
    assert rows == {"frontend": ("frontend", ["@fixture/shared"], []), "backend": ("backend", ["@fixture/shared"], []), "@fixture/shared": ("packages/shared", [], [])}


def test_only_strings_are_kept(spark):
    _, contents = tables(spark, full=FULLSTACK)
    row = packages(contents).filter("path = 'frontend/package.json'").first()
    assert row["dependencies"] == {"react": "1", "@fixture/shared": "*", "url": "http://a"} and row["dev_dependencies"] == {"vite": "2"}


def test_empty(spark):
    assert detect(*tables(spark, full={"a": None})).count() == 0
