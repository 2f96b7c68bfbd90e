"""Path columns and the predicates over them (R8, P8 to P12), and argument defaults."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are never read as text.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "tiff", "pdf", "zip", "gz", "tar", "tgz", "bz2", "7z", "rar", "mp3", "mp4", "mov",
    "avi", "mkv", "wav", "flac", "ogg", "woff", "woff2", "ttf", "eot", "otf", "exe", "dll", "so", "dylib", "bin", "wasm", "class", "lock",
)


def normalised(path: Column) -> Column:
    """Trimmed, with forward slashes, without one leading ./ or / and one trailing /; empty becomes a dot."""
    path = F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"^\.?/", ""), "/$", "")
    return F.when(path == "", F.lit(".")).otherwise(path)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of a base name that does not begin with it; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def in_locale_order(path: Column) -> Column:
    """O1: the path as it is compared by language rules: without case and accents first, which then decide between equals.

    Sorts, windows and min_by over this column use Spark's root collation; equality stays that of the letters.
    """
    return F.collate(path, "UNICODE")


def is_text(path: Column) -> Column:
    return ~extension(path).isin(list(BINARY_EXTENSIONS))


def is_test(path: Column) -> Column:
    """In a tests folder, or named as a test."""
    return path.rlike(r"(^|/)(tests?|__tests__)/") | path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$") | base_name(path).rlike(r"^test_.*\.py$")


def is_script(path: Column) -> Column:
    return path.rlike(r"\.[cm]?[jt]sx?$")


def depth_below(path: Column, root: str) -> Column:
    """Segments of path below root (a dot is the top); null if it is not below it."""
    rest = path if root == "." else F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 20))
    return F.size(F.filter(F.split(rest, "/"), lambda x: x != "")).cast("int")


def path_list(text: Column) -> Column:
    """Sorted distinct paths of a list that commas or line feeds divide."""
    parts = F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(parts, normalised)))


def at_least_one(value, default: int) -> int:
    """A count argument: the floor of a number from 1 on, else the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 1:
        return default
    return math.floor(value)
