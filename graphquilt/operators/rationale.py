"""Comments that give reasons: tagged comment blocks with the symbol they belong to, and the decision record they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import lines

# Tags that open a reason.
TAGS = ("TODO", "FIXME", "HACK", "XXX", "NOTE", "WHY", "SAFETY", "PERF", "REASON", "RATIONALE", "DECISION", "WARNING", "BUG")


def comment_blocks(files: DataFrame, most: int | None = None) -> DataFrame:
    """``path, line, end_line, tag, text, adr`` of every tagged block of adjacent comment lines.

    Islands of comment lines come from a running count over the lines of a file; a
    tag inside a block opens a new one.  The text is whole unless ``most`` cuts it
    to so many characters for display.
    """
    l = lines(files)
    body = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*(?:/\*+|\*+/?|//+!?|#+|--|<!--|;+)\s?", ""), r"\s*(?:\*/|-->)\s*$", ""))
    c = l.where(F.col("text").rlike(r"^\s*(?:/\*|\*|//|#(?!!)|--|<!--|;)")).withColumn("body", body)
    tag = F.upper(F.regexp_extract("body", r"^@?(" + "|".join(TAGS) + r")\b(?:\([^)]*\))?\s*:?", 1))
    c = c.withColumn("tag", F.when(F.col("body").rlike(r"^@?(?:" + "|".join(TAGS) + r")\b"), tag))
    w = Window.partitionBy("path").orderBy("line")
    start = (F.col("line") - F.coalesce(F.lag("line").over(w), F.lit(-9)) > 1) | F.col("tag").isNotNull()
    c = c.withColumn("block", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = c.groupBy("path", "block").agg(F.min("line").alias("line"), F.max("line").alias("end_line"), F.min_by("tag", "line").alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), " ").alias("text"))
    b = b.where("tag is not null")
    text = F.trim(F.regexp_replace("text", r"^@?[A-Za-z]+(?:\([^)]*\))?\s*:?\s*", ""))
    adr = F.regexp_extract("text", r"(?i)\bADR[-\s#]*0*(\d+)", 1)
    return b.select("path", "line", "end_line", "tag", (text if most is None else F.substring(text, 1, most)).alias("text"), F.when(adr != "", adr).alias("adr"))


def with_symbol(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each block with its symbol (``id, name, file_path, start_line, end_line``): the innermost that encloses it, else the next that starts below it."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol"), F.col("file_path").alias("path"), F.col("start_line").alias("symbol_line"), F.coalesce("end_line", "start_line").alias("_end"))
    j = blocks.join(s, "path")
    inside = (F.col("symbol_line") <= F.col("line")) & (F.col("_end") >= F.col("end_line"))
    below = F.col("symbol_line") > F.col("end_line")
    # enclosing first by span, then the nearest start below
    rank = F.when(inside, F.struct(F.lit(0).alias("k"), (F.col("_end") - F.col("symbol_line")).alias("d"), F.col("symbol_id").alias("i"))).when(below, F.struct(F.lit(1).alias("k"), (F.col("symbol_line") - F.col("end_line")).alias("d"), F.col("symbol_id").alias("i")))
    best = j.where(inside | below).groupBy("path", "line").agg(F.min_by(F.struct("symbol_id", "symbol", "symbol_line"), rank).alias("b")).select("path", "line", "b.*")
    return blocks.join(best, ["path", "line"], "left")


def cited_records(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks that cite a decision record with the Markdown file of that number."""
    n = F.regexp_extract("path", r"(?i)(?:^|/)(?:adr[-_]?)?0*(\d+)[-_][^/]*\.mdx?$", 1)
    a = files.select(F.col("path").alias("record"), n.alias("adr")).where("adr <> ''")
    return blocks.where("adr is not null").join(a, "adr").select("path", "line", "adr", "record")
