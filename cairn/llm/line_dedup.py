"""Boilerplate lines: lines seen on many distinct sites are removed from every document.

Each line's sites are counted with HyperLogLog sketches that merge during aggregation. Only lines whose estimate lies
near the threshold are counted exactly. DataFrame functions only.

A line is what stands between line feeds; blank lines are kept and never counted. A null text stays null, a null site
is a site of its own, repeated rows are counted once per site. An empty table stays empty. Texts of any length are taken
whole; a line on exactly min_sites sites goes.

Lines of the table meet chosen lines in two ways. Chosen lines that hold over one in MANY of the lines counted number at
most MANY and are broadcast; only the others are joined by a shuffle, where no line has more rows than that. So no task
gets all rows of a line that stands in most texts. Texts meet their lines likewise: those with over one in HOT of the rows
that lose a line number at most HOT, and what they lose is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import stored

#: Lines, at most, that are broadcast at once (16 bytes each).
MANY = 200_000
#: Texts, at most, whose removed lines are broadcast, and the lines of such a text (4 bytes each): 40 MB together.
HOT, HOT_LINES = 1_000, 10_000


def line_key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.unhex(F.md5(line))


def among(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of lines whose line_key is in chosen (line_key, n), n its rows in lines; chosen is stored."""
    total, least = chosen.agg(F.sum("n"), F.min("n")).first()
    if total is None:
        return lines.limit(0)
    heavy = F.broadcast(chosen.filter(F.col("n") * MANY >= total).select("line_key"))
    met = lines.join(heavy, "line_key", "left_semi")
    if least * MANY >= total:
        return met
    light = chosen.filter(F.col("n") * MANY < total).select("line_key")
    return met.unionByName(lines.join(heavy, "line_key", "left_anti").join(light, "line_key", "left_semi"))


def remove_boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", min_sites: int = 12, lg_k: int = 12, band: float = 0.2) -> DataFrame:
    """All columns of docs, and clean_text, n_lines, n_removed (in place of columns of docs with these names).

    A line goes where it stands on at least min_sites distinct sites. The sketch decides outside
    (1 - band .. 1 + band) * min_sites, exact counts decide inside it; band is over ten standard errors at lg_k 12.
    """
    kept = [c for c in docs.columns if c.lower() not in ("clean_text", "n_lines", "n_removed")]
    text, site = F.col(f"`{text_col}`").cast("string"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\x00"))
    key = F.unhex(F.md5(text))
    lines = docs.select(key.alias("text_key"), site.alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).filter(F.trim("line") != "")
    lines = lines.select("text_key", "site", "at", line_key(F.col("line")).alias("line_key"))
    spread = lines.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    spread = spread.filter(F.col("n") >= low).select("line_key", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = stored(spread.filter(F.col("sites") >= low))
    near = among(lines, spread.filter(F.col("sites") <= high).select("line_key", "n"))
    exact = near.groupBy("line_key").agg(F.countDistinct("site").alias("sites"), F.count("*").alias("n")).filter(F.col("sites") >= min_sites)
    wide = stored(spread.filter(F.col("sites") > high).select("line_key", "n").unionByName(exact.select("line_key", "n")))
    hits = among(lines.select("text_key", "at", "line_key"), wide).groupBy("text_key").agg(F.collect_set("at").alias("gone"), F.count("*").alias("n"))
    hits = stored(hits.select("text_key", "gone", (F.col("n") / F.size("gone")).cast("bigint").alias("copies")))
    losers = hits.agg(F.sum("copies")).first()[0] or 0
    hot = (F.col("copies") * HOT > losers) & (F.size("gone") <= HOT_LINES)
    # equal texts lose the same lines, so positions are gathered once for each distinct text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), text.alias("text"), key.alias("text_key"))
    split = F.split("text", "\n", -1)
    gone = F.coalesce(F.col("hot_gone"), F.col("gone"), F.array().cast("array<int>"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    clean = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.transform(F.array_sort(keep), lambda i: F.get(split, i)), "\n"))
    rows = rows.join(F.broadcast(hits.filter(hot).select("text_key", F.col("gone").alias("hot_gone"))), "text_key", "left")
    # rows that have met theirs, and null texts, go anywhere, by a key that is longer than those of texts
    elsewhere = F.col("hot_gone").isNotNull() | F.col("text_key").isNull()
    rows = rows.withColumn("text_key", F.when(elsewhere, F.unhex(F.concat(F.md5(F.monotonically_increasing_id().cast("string")), F.lit("00")))).otherwise(F.col("text_key")))
    return rows.join(hits.filter(~hot).select("text_key", "gone"), "text_key", "left").select("doc.*", clean.alias("clean_text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"), F.size(gone).alias("n_removed"))
