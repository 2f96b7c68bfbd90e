import json

import pytest

from cairn.operators.findings import findings
from cairn.operators.projects import contexts, doctor_report, doctor_summary
from tests.test_detect import FULLSTACK, tables

SCRIPTS = {"name": "n", "scripts": {"test": "vitest", "build": "tsc", "bad": 1, "a": "b"}, "dependencies": {"express": "1"}}
NODE = {"package.json": json.dumps(SCRIPTS), "src/index.ts": "", "src/main.ts": "", "Dockerfile": "", "compose.yml": "", ".github/workflows/b.yml": "", ".github/workflows/a.yaml": "", "pyproject.toml": '[project.scripts]\nrun = "m:run"\n"build" = "no"\nother = \'o\'\n[x]\nlast = "l"\n'}
GO = {"go.mod": "module x", "Makefile": "", "main.go": "", "cmd/b/z.go": "", "cmd/b/a/m.go": "", "cmd/A/a.go": "", "cmd/x.go": "", "cmd/c/x.txt": ""}
RUST = {"Cargo.toml": '[workspace]\nmembers = ["a"]\n', "Makefile.toml": "", "src/lib.rs": "", **{f"c{k}/src/main.rs": "" for k in range(7)}}
JAVA = {"build.gradle": "", "build.gradle.kts": "", **{f"src/{k}Application.java": "" for k in "dcba"}, "src/main/resources/application.yaml": "", "src/main/resources/application.properties": ""}


@pytest.fixture(scope="module")
def found(spark):
    rows = {}
    for r in findings(*tables(spark, full=FULLSTACK, node=NODE, go=GO, rust=RUST, java=JAVA, requirements={"requirements-dev.txt": "", "src/main.py": "", "main.py": ""})).orderBy("place").collect():
        rows.setdefault((r["repo"], r["output"]), []).append((r["path"], r["text"]))
    return rows


def paths(found, repo, output):
    return [p for p, _ in found[repo, output]]


def test_node(found):
    assert found["node", "name"] == [(None, "n")] and found["full", "name"] == [(None, "root")]
    assert found["node", "script"] == [("test", "vitest"), ("build", "tsc"), ("a", "b"), ("run", "m:run"), ("other", "o")]
    assert found["node", "entry"] == [("src/main.ts", "App entry point"), ("src/index.ts", "Node.js entry point")]
    assert paths(found, "node", "important") == ["package.json", "Dockerfile", "compose.yml", ".github/workflows/a.yaml", ".github/workflows/b.yml", "pyproject.toml"]
    assert found["full", "important"] == [("package.json", "Project metadata, scripts and dependency declarations"), ("backend/prisma/schema.prisma", "Prisma data model and database connection config")]


def test_other_languages(found):
    assert found["go", "entry"] == [("main.go", "Go main entry point"), ("cmd/A/a.go", "CLI binary: A"), ("cmd/b/a/m.go", "CLI binary: b")]
    assert paths(found, "go", "important") == ["go.mod", "Makefile"]
    assert found["rust", "entry"] == [("src/lib.rs", "Rust library entry point")] + [(f"c{k}/src/main.rs", f"Workspace binary: c{k}") for k in range(5)]
    assert found["rust", "important"] == [("Cargo.toml", "Monorepo workspace configuration"), ("Makefile.toml", "Build and task automation")]
    assert paths(found, "java", "entry") == [f"src/{k}Application.java" for k in "abc"]
    assert paths(found, "java", "important") == ["build.gradle.kts", "src/main/resources/application.yaml"]
    assert found["requirements", "important"] == [("requirements.txt", "Python dependencies")]
    assert found["requirements", "entry"] == [("main.py", "Application entry point")]


def test_contexts(spark):
    mono = {"package.json": json.dumps({"name": "top", "scripts": {"x": "y"}}), "Dockerfile": "", "src/index.ts": "", "src/lib/deep/a.txt": "", "web/package.json": "{}", "web/src/app.ts": "", "web/assets/b.txt": ""}
    files, contents = tables(spark, mono=mono, **{"git/bare": {"a/b.txt": ""}})
    asked = [("mono", "."), ("mono", "web"), ("mono", "src/lib"), ("mono", "./src/"), ("mono", "web/assets"), ("mono", "nowhere/at"), ("git/bare", "."), ("git/bare", "a"), ("none", "."), ("mono", None)]
    rows = {(r["repo"], r["root"]): r for r in contexts(spark.createDataFrame(asked, "repo string, root string"), files, contents).collect()}
    assert len(rows) == 9
    top = rows["mono", "."]
    assert (top["project_name"], top["features"], top["tech"], top["warning"], top["project_root"]) == ("top", ["Docker", "Node.js package"], ["Docker"], None, None)
    assert [tuple(e) for e in top["entry_points"]] == [("src/index.ts", "Node.js entry point")] and [tuple(s) for s in top["scripts"]] == [("x", "y")] and top["workspace_files"] == []
    web = rows["mono", "web"]
    assert (web["project_name"], web["warning"], [e["path"] for e in web["entry_points"]]) == ("web", None, ["src/app.ts"])
    lib, src = rows["mono", "src/lib"], rows["mono", "src"]
    assert (lib["project_name"], lib["warning"], lib["project_root"], lib["entry_points"], lib["important_files"]) == ("top", "upstream", ".", [], [])
    assert [e["path"] for e in src["entry_points"]] == ["index.ts"] and [f["path"] for f in src["workspace_files"]] == ["package.json", "Dockerfile"]
    assert (rows["mono", "web/assets"]["project_root"], rows["mono", "web/assets"]["project_name"]) == ("web", "assets") and rows["mono", "nowhere/at"]["project_root"] == "."
    assert [(rows[k]["project_name"], rows[k]["warning"], rows[k]["scripts"]) for k in (("git/bare", "."), ("git/bare", "a"), ("none", "."))] == [("bare", "no_project", []), ("a", "no_project", []), ("none", "no_project", [])]


def test_doctor(spark):
    good = {"README.md": "", "package.json": "{}", "a/tests/x": "", ".github/workflows/a.yml": "", "compose.yaml": "", "cairn.config.json": '{"maxDepth": 3, "ignore": [], "includeCi": false, "more": 1, // c\n}'}
    wrong = {"cairn.config.json": json.dumps({"maxDepth": 0, "ignore": ["a", 1], "includeCi": None, "includeTests": True})}
    held = {"good": good, "wrong": wrong, "list": {"cairn.config.json": "[]"}, "broken": {"cairn.config.json": "{", "a.test.ts": ""}, "half": {"cairn.config.json": '{"maxDepth": 1.5}'}, "strings": {"cairn.config.json": '{"ignore": ["a"]}'}}
    report = doctor_report(spark.createDataFrame([(r,) for r in [*held, "gone"]], "repo string"), *tables(spark, **held))
    rows = {}
    for r in report.orderBy("place").collect():
        rows.setdefault(r["repo"], []).append((r["label"], r["status"], r["message"]))
    assert [s for _, s, _ in rows["good"]] == ["pass"] * 7 and len(rows["broken"]) == 7 and rows["broken"][4][1] == "pass"
    assert rows["wrong"] == [("target path", "pass", "Path exists and is readable"), ("config", "fail", "Config file error: maxDepth, ignore, includeCi")]
    assert [rows[k][1][2] for k in ("list", "half", "strings")] == ["Config file error: .", "Config file error: maxDepth", "Config file is valid"]
    assert rows["gone"][0] == ("target path", "fail", "Path does not exist: gone") and [s for _, s, _ in rows["gone"][2:]] == ["warning"] * 5
    assert {r["repo"]: tuple(r)[1:] for r in doctor_summary(report).collect()}["gone"] == (1, 5, 1)


def test_nothing(spark):
    files, contents = tables(spark, a={"x": ""})
    none = files.limit(0)
    assert findings(none, contents.limit(0)).count() == 0 and findings(files, contents).count() == 0
    assert contexts(none.withColumn("root", none["path"]), none, contents.limit(0)).count() == 0 and doctor_report(none, files, contents).count() == 0
