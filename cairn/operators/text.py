"""Line tables, line search, name search and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.globs import path_match
from cairn.functions.paths import at_least_one, depth_below, in_locale_order, is_text

MOST_CHARS, HEAD_CHARS, MOST_SHOWN = 2_000_000, 8_000, 240


def readable(contents: DataFrame) -> DataFrame:
    """Rows of (path, content) that are searched: text by name, not too long, no NUL near the start."""
    content = F.col("content")
    return contents.filter(is_text(F.col("path")) & content.isNotNull() & (F.length(content) <= MOST_CHARS) & (F.instr(F.substring(content, 1, HEAD_CHARS), "\0") == 0))


def lines(contents: DataFrame) -> DataFrame:
    """(path, line, text): lines from 1 on; a final empty line is kept. Other columns than content stay."""
    kept = [F.col(f"`{c}`") for c in contents.columns if c != "content"]
    return readable(contents).select(*kept, F.posexplode(F.split("content", r"\r?\n", -1)).alias("at", "text")).select(*kept, (F.col("at") + 1).alias("line"), "text")


def shown(text: Column) -> Column:
    """A line without trailing blanks, cut at 240 characters."""
    cut = F.regexp_replace(text, r"\s+$", "")
    return F.when(F.length(cut) > MOST_SHOWN, F.concat(F.substring(cut, 1, MOST_SHOWN), F.lit("\u2026"))).otherwise(cut)


def valid_regex(spark, pattern: str) -> bool:
    """A pattern that cannot be compiled gives no matches, instead of failing the job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def line_match(text: Column, pattern: str, regex: bool, ignore_case: bool | None) -> Column:
    """Literal search ignores case unless told otherwise, regex search does not."""
    if regex:
        return text.rlike(("(?i)" if ignore_case else "") + pattern)
    if ignore_case is None or ignore_case:
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    return F.contains(text, F.lit(pattern))


def grep(contents: DataFrame, pattern: str, *, regex: bool = False, ignore_case: bool | None = None, glob: str | None = None, limit=None) -> DataFrame:
    """(path, line, text) of the first `limit` matching lines in the order of path and line."""
    if regex and not valid_regex(contents.sparkSession, pattern):
        return contents.sparkSession.createDataFrame([], "path string, line int, text string")
    rows = contents if glob is None else contents.filter(path_match(F.col("path"), glob))
    found = lines(rows.select("path", "content")).filter(line_match(F.col("text"), pattern, regex, ignore_case))
    return found.orderBy("path", "line").limit(at_least_one(limit, 100)).select("path", "line", shown(F.col("text")).alias("text"))


def grep_report(contents: DataFrame, pattern: str, *, glob: str | None = None, limit=None, **how) -> DataFrame:
    """One row (count, truncated, scanned_files). truncated: the limit was met. Files count up to the last match then."""
    most = at_least_one(limit, 100)
    found = grep(contents, pattern, glob=glob, limit=limit, **how)
    ends = found.agg(F.count("*").alias("count"), F.max("path").alias("last"))
    rows = readable(contents if glob is None else contents.filter(path_match(F.col("path"), glob))).select("path")
    scanned = rows.join(F.broadcast(ends)).agg(F.count_if((F.col("count") < most) | (F.col("path") <= F.col("last"))).alias("scanned_files"))
    return ends.select("count", (F.col("count") >= most).alias("truncated")).join(F.broadcast(scanned))


def directories(files: DataFrame) -> DataFrame:
    """(path) of all folders of the files."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.filter(F.contains("path", F.lit("/"))).select(F.explode(ups).alias("path")).distinct()


def search(files: DataFrame, dirs: DataFrame | None = None, symbols: DataFrame | None = None, *, pattern: str, limit=None) -> DataFrame:
    """(ord, kind, path, name) of files, then folders, then symbols that fit, cut after all are joined.

    A symbol fits by its name, its file or its container.
    """
    parts = [files.filter(path_match(F.col("path"), pattern)).select(F.lit(0).alias("ord"), F.lit("file").alias("kind"), "path", F.lit("").alias("name"))]
    if dirs is not None:
        parts.append(dirs.filter(path_match(F.col("path"), pattern)).select(F.lit(1).alias("ord"), F.lit("directory").alias("kind"), "path", F.lit("").alias("name")))
    if symbols is not None:
        fits = reduce(lambda a, b: a | b, [F.coalesce(path_match(F.col(c), pattern), F.lit(False)) for c in ("name", "path", "container")])
        parts.append(symbols.filter(fits).select(F.lit(2).alias("ord"), "kind", "path", "name"))
    return reduce(DataFrame.unionByName, parts).orderBy("ord", "path", "name").limit(at_least_one(limit, 100))


def ordered_tree(files: DataFrame, root: str = ".", depth=None) -> DataFrame:
    """The rows of `tree` in the order in which they are shown."""
    return tree(files, root, depth).orderBy(in_locale_order(F.col("path")), "entry")


def tree(files: DataFrame, root: str = ".", depth=None) -> DataFrame:
    """(path, entry) of files and folders up to depth below root; a folder's entry ends with a slash."""
    both = files.select("path", F.lit("").alias("end")).unionByName(directories(files).select("path", F.lit("/").alias("end")))
    level = depth_below(F.col("path"), root)
    return both.filter(level.isNotNull() & (level <= at_least_one(depth, 3))).select("path", F.concat(F.lit("- "), "path", "end").alias("entry"))
