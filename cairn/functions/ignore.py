"""Ignore rules in the manner of gitignore, as one regular expression over paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from cairn.functions.globs import glob_regex

#: What is left out unless a config says otherwise, and what its switches add.
DEFAULT_IGNORE = ("node_modules", "dist", "build", ".git", "coverage", ".next", "target")
TEST_RULES = ("tests", "**/*.test.*", "**/*.spec.*")
CI_RULES = (".github/workflows",)
DOCKER_RULES = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


@dataclass(frozen=True)
class ScanConfig:
    """Scan settings; unknown keys of a mapping are dropped, wrong values are refused."""

    max_depth: int = 4
    ignore: tuple[str, ...] = DEFAULT_IGNORE
    include_tests: bool = True
    include_scripts: bool = True
    include_ci: bool = True
    include_docker: bool = True
    _keys: dict = field(default_factory=lambda: {"maxDepth": "max_depth", "ignore": "ignore", "includeTests": "include_tests", "includeScripts": "include_scripts", "includeCi": "include_ci", "includeDocker": "include_docker"}, repr=False, compare=False)

    @classmethod
    def of(cls, given: dict) -> ScanConfig:
        names, found, wrong = cls()._keys, {}, []
        for key, value in given.items():
            if key not in names:
                continue
            if key == "maxDepth":
                fine = isinstance(value, int) and not isinstance(value, bool) and value > 0
            elif key == "ignore":
                fine = isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value)
            else:
                fine = isinstance(value, bool)
            if not fine:
                wrong.append(f"{key}: {value!r} is not allowed")
            found[names[key]] = tuple(value) if key == "ignore" and fine else value
        if wrong:
            raise ValueError(", ".join(wrong))
        return cls(**found)

    def rules(self) -> list[str]:
        out = list(self.ignore)
        out += () if self.include_tests else TEST_RULES
        out += () if self.include_ci else CI_RULES
        out += () if self.include_docker else DOCKER_RULES
        return out


def ignore_regex(rules: list[str]) -> str:
    """A regular expression that finds ignored paths, and all that lies below an ignored folder.

    A rule without a slash, but at its end, holds at any depth; others count from the top. Comments and blank rules are
    skipped.
    """
    parts = []
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        body = rule.rstrip("/")
        top = "/" in body
        core = glob_regex(body.lstrip("/")).replace(r"(?!\.)", "")  # here a star fits a leading dot too
        parts.append(("^" if top else "(?:^|/)") + f"(?:{core})(?:/|$)")
    return "|".join(parts) or r"(?!)"


def is_ignored(path: str, regex: str) -> bool:
    return re.search(regex, path) is not None
