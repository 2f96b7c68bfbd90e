"""Facts of source texts, taken in one pass.

`source_facts` reads each text once, in Arrow batches, and emits one row for each statement, symbol and called name. What
follows (edges, symbols, calls) joins these rows and never sees a text again. Texts, and all that is derived from them, are
kept apart by `repo`; contents without that column are one repository.

A pass over a text costs one search for each pattern; lines are found by bisection among the text's line ends, so a file with
many matches costs no more than its length and its matches.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extensions of files with script imports, and of files with symbols.
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs"]
SYMBOL_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs"]
#: Import and re-export statements as (pattern, group of the names or 0, group of the module).
SCRIPT_IMPORTS = [
    (r"""import\s+(?:type\s+)?(\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""", 1, 2),
    (r"""import\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 1, 2),
    (r"""import\s+\*\s+as\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 1, 2),
    (r"""import\s+['"]([^'"]+)['"]""", 0, 1),
    (r"""export\s+(?:type\s+)?(\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""", 1, 2),
    (r"""export\s+\*\s+(?:as\s+\w+\s+)?from\s+['"]([^'"]+)['"]""", 0, 1),
]
#: Python's import statements, by the module that they may name, and Go's.
PYTHON_IMPORT = r"(?m)^import\s+(.+)$"
PYTHON_FROM = r"(?m)^from\s+(%s)\s+import\s+(?:\(([\s\S]*?)\)([^\n]*)|(.+)$)"
PYTHON_MODULES = (r"[A-Za-z_][\w.]*", r"\.+[\w.]*")
GO_MODULE, GO_IMPORT, GO_BLOCK, GO_NAME = r"(?m)^module\s+(\S+)", r'import\s+"([^"]+)"', r"import\s*\(([\s\S]*?)\)", r'"([^"]+)"'
#: Declarations as (kind, pattern, default, exported), in the order of their rank.
DECLARED = [
    ("function", r"export\s+(?:async\s+)?function\s+(\w+)", False, True),
    ("function", r"export\s+default\s+(?:async\s+)?function\s+(\w+)", True, True),
    ("class", r"export\s+class\s+(\w+)", False, True),
    ("class", r"export\s+default\s+class\s+(\w+)", True, True),
    ("interface", r"export\s+(?:declare\s+)?interface\s+(\w+)", False, True),
    ("type", r"export\s+(?:declare\s+)?type\s+(\w+)\s*[=<{]", False, True),
    ("const", r"export\s+(?:declare\s+)?(?:const|let|var)\s+(\w+)", False, True),
    ("enum", r"export\s+(?:declare\s+)?enum\s+(\w+)", False, True),
    ("variable", r"export\s+\{([^}]+)\}(?!\s*from)", False, True),
    ("function", r"(?<![\w.])(?:async\s+)?function\s+(\w+)\s*\(", False, False),
    ("const", r"(?<![\w.])(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", False, False),
]
#: What opens a class, a method in its body, and the body of an exported function.
CLASS = r"(?:export\s+(?:default\s+)?)?class\s+(\w+)[^{]*\{"
METHOD = r"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|override|async)\s+)*(#?\w+)\s*(?:<[^>{}]+>)?\s*\([^;{}]*\)\s*(?::\s*[^{}]+)?\{"
FUNCTION = r"export\s+(?:async\s+)?function\s+(\w+)[^{]*\{"
FUNCTION_VALUE = r"export\s+(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>\s*\{|export\s+(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function\b[^{]*\{"
#: Fixed value: what follows a called name, or a name whose member is called.
BRACES = re.compile("[{}]")
CALLED = r"([\w$]++)(?=\s*\(|\s*\.\s*\w+\s*\()"

FACTS = "repo string, path string, fact string, rank int, pos int, k int, line int, name string, kind string, is_default boolean, exported boolean, container string, g1 string, g2 string, g3 string, g4 string"
NAMES = [column.split()[0] for column in FACTS.split(", ")]
TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
ARROW = pa.schema([(name, TYPES[kind]) for name, kind in (column.split() for column in FACTS.split(", "))])
EMITTED = 20_000


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def needed(pattern: str) -> set[str]:
    """Words that stand in every text that a pattern matches, outside its groups and classes."""
    bare = re.sub(r"\\.|\[[^\]]*\]", " ", re.sub(r"\\.", " ", pattern))
    while (less := re.sub(r"\([^()]*\)", " ", bare)) != bare:
        bare = less
    return set.intersection(*(set(re.findall(r"[a-z]+|=>", part)) for part in bare.split("|")))


def block_end(text: str, at: int) -> int | None:
    """X11: the place of the brace that closes the one at `at`; strings and comments are not told apart."""
    depth = 0
    for found in BRACES.finditer(text, at):
        depth += 1 if found[0] == "{" else -1
        if depth == 0:
            return found.start()
    return None


def blocks(text: str, opener: re.Pattern, resume: bool):
    """(name, start, place of the brace, place of its end) of the blocks that opener opens.

    With `resume`, the search goes on behind each closed block, else behind the opening brace.
    """
    at = 0
    while m := opener.search(text, at):
        at, end = m.end(), block_end(text, m.end() - 1)
        if end is not None:
            yield next(g for g in m.groups() if g), m.start(), m.end() - 1, end
            at = end + 1 if resume else at


def starts_of(name: str):
    """Where a name can begin in a run of word characters and dollars: at every change between the two."""
    if "$" not in name:
        return [0]
    word = [c != "$" for c in name]
    return [i for i in range(len(name)) if (word[i - 1] != word[i] if i else word[0])]


class Extractor:
    """The patterns, compiled once a task."""

    def __init__(self):
        self.imports = [(compiled(p), names, module) for p, names, module in SCRIPT_IMPORTS]
        self.python = [compiled(PYTHON_IMPORT), *(compiled(PYTHON_FROM % m) for m in PYTHON_MODULES)]
        self.go = [compiled(p) for p in (GO_MODULE, GO_IMPORT, GO_BLOCK, GO_NAME)]
        self.declared = [(kind, compiled(p), default, exported) for kind, p, default, exported in DECLARED]
        self.classes, self.method, self.functions, self.called = compiled(CLASS), compiled(METHOD), [compiled(FUNCTION), compiled(FUNCTION_VALUE)], compiled(CALLED)
        self.needed = [[needed(p.pattern) for p in patterns] for patterns in ((p for p, *_ in self.imports), (p for _, p, *_ in self.declared), [self.classes, *self.functions])]
        self.words = set().union(*(words for group in self.needed for words in group))

    def tried(self, text: str) -> list[list[bool]]:
        """Of imports, declarations and blocks: whether a text has the words of each pattern, so that the others need no search."""
        there = {word for word in self.words if word in text}
        return [[words <= there for words in group] for group in self.needed]

    def facts(self, path: str, text: str, declared: bool = True):
        """Facts of one text, as dictionaries; without `declared` its statements alone."""
        if path.endswith(tuple(SCRIPT_EXTENSIONS)):
            tried = self.tried(text)
            for rank, (pattern, names, module) in enumerate(self.imports):
                if not tried[0][rank]:
                    continue
                for pos, m in enumerate(pattern.finditer(text)):
                    if m[module].startswith("."):
                        yield {"fact": "script", "rank": rank, "pos": pos, "g1": m[names] if names else None, "g2": m[module]}
        if path.endswith(".py"):
            for rank, pattern in enumerate(self.python):
                for pos, m in enumerate(pattern.finditer(text)):
                    yield {"fact": "python", "rank": rank, "pos": pos} | {f"g{k}": g or "" for k, g in enumerate(m.groups(), 1)}
        module, one, block, name = self.go
        if path.endswith(".go"):
            found = one.findall(text) + [n for b in block.findall(text) for n in name.findall(b)]
            for pos, n in enumerate(dict.fromkeys(found)):
                yield {"fact": "go", "pos": pos, "g1": n}
        if path.rpartition("/")[2] == "go.mod" and (m := module.search(text)):
            yield {"fact": "module", "g1": m[1]}
        if declared and path.endswith(tuple(SYMBOL_EXTENSIONS)):
            yield from self.symbols(text, tried)

    def symbols(self, text: str, tried: list[list[bool]] | None = None):
        tried = self.tried(text) if tried is None else tried
        ends = [m.end() for m in re.finditer("\n", text)]
        line = lambda at: bisect_right(ends, at) + 1  # noqa: E731  X10
        for rank, (kind, pattern, default, exported) in enumerate(self.declared):
            if not tried[1][rank]:
                continue
            base = {"fact": "symbol", "rank": rank, "kind": kind, "is_default": default, "exported": exported, "container": ""}
            for pos, m in enumerate(pattern.finditer(text)):
                names = [m[1]]
                if kind == "variable":
                    parts = [re.sub(r"\s+as\s+\w+$", "", p.strip(), flags=re.ASCII) for p in m[1].split(",")]
                    names = [p for p in parts if re.fullmatch(r"\w+", p, re.ASCII)]
                for k, name in enumerate(names):
                    yield base | {"pos": pos, "k": k, "name": name, "line": line(m.start())}
        for pos, (owner, _, brace, end) in enumerate(blocks(text, self.classes, resume=False) if tried[2][0] else ()):
            for k, m in enumerate(self.method.finditer(text[brace + 1 : end])):
                if m[1] not in ("constructor", owner):
                    yield {"fact": "symbol", "rank": len(self.declared), "pos": pos, "k": k, "name": m[1].removeprefix("#"), "kind": "method", "is_default": False, "exported": False, "container": owner, "line": line(brace + 1 + m.start())}
        for rank, pattern in enumerate(self.functions):
            if not tried[2][rank + 1]:
                continue
            for pos, (symbol, start, brace, end) in enumerate(blocks(text, pattern, resume=True)):
                body, seen = text[start:brace] + text[brace + 1 : end], set()  # X12: the head and what the braces hold
                for m in self.called.finditer(body):
                    for name in (m[1][i:] for i in starts_of(m[1])):
                        if name not in seen:  # the first call of a name in a body counts
                            seen.add(name)
                            yield {"fact": "call", "rank": rank, "pos": pos, "name": name, "container": symbol, "line": line(start + m.start())}


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows in the order of NAMES, by column."""
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), ARROW.types)], schema=ARROW)


def source_facts(contents: DataFrame, declared: bool = True) -> DataFrame:
    """(repo, path, fact, ..) rows of contents (path, content, and repo or one repository); see FACTS.

    fact is script, python or go (a statement), module (of a go.mod), symbol, or call (a name called in an exported function,
    with its first line). Null contents, paths and repositories have no facts. Without `declared`, symbols and calls are not sought.
    """
    repo = F.col("repo").cast("string") if "repo" in contents.columns else F.lit("")
    rows = contents.select(repo.alias("repo"), F.col("path"), F.col("content")).filter("repo is not null and path is not null and content is not null")

    def run(batches):
        extractor, out = Extractor(), []
        for batch in batches:
            for repo, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for fact in extractor.facts(path, text, declared):
                    out.append((repo, path, *map(fact.get, NAMES[2:])))
                    if len(out) >= EMITTED:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, FACTS)
