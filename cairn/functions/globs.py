"""Glob patterns as Java regular expressions (P1, P2) and token patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = set("*?[]{}()!+@")


def is_glob(pattern: str) -> bool:
    return bool(MAGIC & set(pattern))


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: * and ? stay in a segment and do not match a leading dot, ** spans segments."""
    out, i, closers = [], 0, []
    segment_start = True
    no_dot = r"(?!\.)"
    while i < len(pattern):
        c = pattern[i]
        guard = no_dot if segment_start else ""
        two = pattern[i : i + 2]
        if c in "@+?*!" and two[1:] == "(":
            closers.append({"@": ")", "+": ")+", "?": ")?", "*": ")*", "!": ")[^/]*"}[c])
            out.append("(?!" if c == "!" else "(?:")
            if c == "!":
                closers[-1] = "$)[^/]*"
            i += 2
            continue
        if pattern[i : i + 3] == "**/" and segment_start:
            out.append(rf"(?:(?!\.)[^/]+/)*")
            i += 3
            continue
        if two == "**":
            out.append(rf"(?:{guard}[^/]*(?:/{no_dot}[^/]*)*)")
            i += 2
        elif c == "*":
            out.append(f"{guard}[^/]*" if i + 1 < len(pattern) and pattern[i + 1] != "/" or not segment_start else f"{guard}[^/]+")
            i += 1
        elif c == "?":
            out.append(f"{guard}[^/]")
            i += 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
        elif c == "{" and "}" in pattern[i:]:
            closers.append("}")
            out.append("(?:")
            i += 1
            continue
        elif c == "," and "}" in closers:
            out.append("|")
            i += 1
            continue
        elif c == "|" and closers:
            out.append("|")
            i += 1
            continue
        elif c == "}" and closers and closers[-1] == "}":
            closers.pop()
            out.append(")")
            i += 1
        elif c == ")" and closers and closers[-1] != "}":
            out.append(closers.pop())
            i += 1
        else:
            out.append("\\" + c if not c.isalnum() and c not in "_/ " and ord(c) < 128 else c)
            i += 1
        segment_start = c == "/"
    return "".join(out)


def glob_match(path: Column, pattern: str) -> Column:
    """The whole path, or what follows any folder, fits the glob; case is ignored."""
    rule = glob_regex(pattern)
    return path.rlike(f"(?i)^(?:{rule})$") | path.rlike(rf"(?i)^(?:(?!\.)[^/]+/)*(?:{rule})$")


def token_match(text: Column, pattern: str) -> Column:
    """Every blank-separated token of the pattern stands somewhere in the text; case is ignored."""
    tokens = pattern.lower().split()
    lowered = F.lower(text)
    return F.lit(True) if not tokens else F.forall(F.array(*map(F.lit, tokens)), lambda t: F.contains(lowered, t))


def path_match(path: Column, pattern: str) -> Column:
    return glob_match(path, pattern) if is_glob(pattern) else token_match(path, pattern)
