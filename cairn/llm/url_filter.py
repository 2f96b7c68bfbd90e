"""URL rules: host-suffix and path-prefix expressions matched by short hash prefixes, then by full digests.

The work stays in DataFrame functions. A null url, or one without `://`, has an empty host and path and gets the
default verdict. Repeated rows are judged one by one. Extra columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A rule set of at most this many rules is broadcast; a larger one is shuffled on the hash prefix.
BROADCAST_RULES = 200_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, LETTERS, LETTERS.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """Judge every row's url by the longest rule that fits.

    rules has (host, path, action). A rule fits its host and every subdomain whose url path starts with the rule's
    path. Of the rules that fit, the longest expression host+path wins; then the longer host; then block over allow.
    Returns (id_col, host, path, rule, verdict); rule is null where none fits.
    """
    expression = F.concat(F.col("host"), F.col("path"))
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").filter("host is not null and host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    # prefixes of other lengths than the rules' paths can match none: at most as many lengths as the longest path has
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    tries = urls.select("row", "id", "host", "path", F.explode_outer(expressions).alias("try"))
    tries = tries.withColumn("digest", F.sha2(F.concat("try.h", F.lit("\x00"), "try.p"), 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    rules = rules.select(
        expression.alias("rule"), "action", F.length("host").alias("host_n"), F.length(expression).alias("rule_n"),
        F.sha2(F.concat("host", F.lit("\x00"), "path"), 256).alias("full"),
    ).withColumn("key", F.substring("full", 1, prefix_hex))
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    met = tries.join(rules, F.col("short") == F.col("key"), "left")  # expressions that only share the prefix are told apart after it
    best = met.groupBy("row", "id", "host", "path").agg(
        F.max(F.when(F.col("digest") == F.col("full"), F.struct("rule_n", "host_n", (F.col("action") == "block").alias("block"), "rule", "action"))).alias("best")
    )
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
