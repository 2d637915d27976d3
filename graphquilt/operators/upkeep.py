"""Upkeep of a store: what no longer fits, moves of a root, coverage and small summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(rows: DataFrame, column: str, *owners: DataFrame) -> DataFrame:
    """Rows whose ``column`` none of the owner tables (their first column) has; a row without an owner's key is one too."""
    known = reduce(DataFrame.unionAll, [o.select(F.col(o.columns[0]).alias("_k")) for o in owners]).where("_k is not null").distinct()
    return rows.join(known, F.col(column) == F.col("_k"), "left_anti")


def stale_edges(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Distinct stored edges (``from_id, to_id``) that a new derivation no longer gives."""
    keys = ["from_id", "to_id"]
    return stored.select(*keys).distinct().join(derived.select(*keys).distinct(), keys, "left_anti")


def relocate(rows: DataFrame, old: str, new: str, *columns: str) -> DataFrame:
    """Rows with the prefix ``old`` of the given columns replaced, at a folder's border only; other values stay."""
    a, b = old.rstrip("/"), new.rstrip("/")

    def moved(c: Column) -> Column:
        return F.when(c == a, F.lit(b)).when(c.startswith(a + "/"), F.concat(F.lit(b), F.substr(c, F.lit(len(a) + 1)))).otherwise(c)

    return rows.withColumns({c: moved(F.col(c)) for c in columns})


def recall_stats(counts: DataFrame) -> DataFrame:
    """One row of searches by outcome (``outcome, n``): totals and the rates of empty and weak ones; other outcomes are ignored."""
    known = ("high", "medium", "low", "zero")
    c = counts.agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in known])
    total = reduce(lambda x, y: x + y, [F.col(k) for k in known])
    rate = lambda k: F.when(total > 0, F.format_string("%.1f%%", 100.0 * F.col(k) / total)).otherwise("0%")
    return c.select(total.alias("searches"), *known, rate("zero").alias("zero_hit_rate"), rate("low").alias("low_confidence_rate"))


def import_coverage(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports per language of the importing file, and how many lead to a known file: ``lang, seen, resolved``."""
    lang = files.groupBy(F.col("path").alias("from_path")).agg(F.max("lang").alias("lang"))
    there = files.select(F.col("path").alias("to_path")).where("to_path is not null").distinct().withColumn("_there", F.lit(1))
    # counted by pair first: a module that everybody imports is one row per importer
    pairs = imports.groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("n"))
    j = pairs.join(lang, "from_path", "left").join(there, "to_path", "left")
    return j.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.sum("n").alias("seen"), F.coalesce(F.sum(F.when(F.col("_there") == 1, F.col("n"))), F.lit(0)).alias("resolved"))


def first_call_site(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The first call between two files, ``a, b, line, from_id, to_id``: the least by line of the calling function, then ends."""
    f = functions.groupBy("id").agg(F.max(F.struct("file_path", "start_line")).alias("f"))
    e = calls.where("from_id is not null and to_id is not null").select("from_id", "to_id").distinct()
    j = e.join(f.select(F.col("id").alias("from_id"), F.col("f.file_path").alias("a"), F.col("f.start_line").alias("line")), "from_id").join(f.select(F.col("id").alias("to_id"), F.col("f.file_path").alias("b")), "to_id")
    return j.where("a <> b").groupBy("a", "b").agg(F.min(F.struct("line", "from_id", "to_id")).alias("m")).select("a", "b", "m.line", "m.from_id", "m.to_id")


def definition_order(names: DataFrame, word: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` definitions (``id, name, file_path``) in the order a reader wants them: the name itself first, code before tests and documents, short paths first."""
    low = F.lower("name")
    match = F.when(low == word.lower(), 0).when(low.startswith(word.lower()), 1).otherwise(2)
    late = F.col("file_path").rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|\.(md|mdx|rst|txt)$").cast("int")
    order = ("match", "late", F.length("file_path"), "id")
    first = names.where(F.contains(low, F.lit(word.lower()))).withColumn("match", match).withColumn("late", late).orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("id", "match", "rank")


def file_tiers(hits: DataFrame, top: int = 3, more: int = 5) -> DataFrame:
    """Files of found symbols (``query, file_path, score, is_test, has_code``) in tiers: the best score plus 0.3 of the rest, halved for tests and for files without code; ``top`` files first, then ``more``."""
    g = hits.groupBy("query", "file_path").agg(F.max("score").alias("_b"), F.sum("score").alias("_s"), F.max("is_test").alias("_t"), F.max("has_code").alias("_c"))
    score = (F.col("_b") + 0.3 * (F.col("_s") - F.col("_b"))) * F.when(F.col("_t"), 0.5).otherwise(1.0) * F.when(F.col("_c"), 1.0).otherwise(0.5)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "file_path")
    r = g.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top + more)
    return r.select("query", "file_path", "score", "rank", F.when(F.col("rank") < top, 1).otherwise(2).alias("tier"))


def scoped(**scopes: DataFrame) -> DataFrame:
    """Results of several repositories as one table with their ``scope``; columns that one lacks are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn("scope", F.lit(name)) for name, df in scopes.items()])


def module_doc(files: DataFrame, most: int = 240) -> DataFrame:
    """What a file says of itself at its top (``path, body``): docstring, leading block comment, first paragraph of Markdown or leading hash comments, in one line of at most ``most`` characters (the feature's own length); '' where it says nothing."""
    p, body = F.lower("path"), F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n")
    py = F.regexp_extract(body, r"(?s)\A(?:\s|#[^\n]*\n)*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", 0)
    py = F.regexp_replace(F.regexp_replace(py, r"(?s)\A(?:\s|#[^\n]*\n)*(?:\"\"\"|''')", ""), "(?:\"\"\"|''')$", "")
    block = F.regexp_replace(F.regexp_extract(body, r"(?s)\A\s*/\*\*?(.*?)\*/", 1), r"(?m)^\s*\*+ ?", "")
    md = F.regexp_extract(body, r"(?s)\A(?:\s|#[^\n]*\n)*([^\n#].*?)(?:\n\s*\n|\z)", 1)
    hashed = F.regexp_replace(F.regexp_extract(body, r"\A\s*((?:#[^\n]*(?:\n|\z))+)", 1), r"(?m)^#+!?[^\S\n]*", "")
    raw = F.when(p.endswith(".py"), py).when(p.rlike(r"\.(ts|tsx|js|mjs|vue)$"), block).when(p.rlike(r"\.mdx?$"), md).when(p.rlike(r"\.(tf|tfvars|ya?ml|sh|bash|toml)$|(^|/)dockerfile$"), hashed).otherwise("")
    said = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?is)\A.*?\bdescription:\s*", ""), r"\s+", " "))
    return files.select("path", F.substring(said, 1, most).alias("module_doc"))
