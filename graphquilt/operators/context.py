"""What a task needs to see: symbols found by text, their neighbours, notes and plans, and a digest of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize_identifier
from . import graph, search

#: Neighbours taken from each found symbol on either side (the feature's own cap).
EXPANSION = 3


def for_task(tasks: DataFrame, functions: DataFrame, calls: DataFrame, memory: DataFrame, plans: DataFrame, most: int = 10) -> DataFrame:
    """``query, kind, key, score, why`` for each task (``query, text``): symbol hits, their callers and callees, notes and plans."""
    hits = search.search(functions.select("id", "name", "docstring"), "id", tokenize_identifier("name"), F.col("docstring"), tasks, most)
    found = hits.select("query", F.lit("symbol").alias("kind"), F.col("doc").alias("key"), "score", F.lit("text").alias("why"))
    e = graph.live(graph.pairs(calls, "from_id", "to_id"), functions, "id")
    around = []
    for why, a, b in (("caller", "dst", "src"), ("callee", "src", "dst")):
        j = found.join(e, F.col("key") == F.col(a)).select("query", F.col("key").alias("seed"), F.col(b).alias("n"), "score")
        w = Window.partitionBy("query", "seed").orderBy("n")
        j = j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= EXPANSION)
        around.append(j.groupBy("query", F.col("n").alias("key")).agg((F.max("score") / 2).alias("score")).select("query", F.lit("symbol").alias("kind"), "key", "score", F.lit(why).alias("why")))
    near = around[0].unionByName(around[1]).join(found.select("query", "key"), ["query", "key"], "left_anti").dropDuplicates(["query", "key"])
    out = found.unionByName(near.select(found.columns))
    for name, df in (("memory", memory), ("plan", plans)):
        h = search.search(df.select("path", "title", "body"), "path", F.col("title"), F.col("body"), tasks, EXPANSION)
        out = out.unionByName(h.select("query", F.lit(name).alias("kind"), F.col("doc").alias("key"), "score", F.lit("text").alias("why")))
    return out


def locations(hits: DataFrame, symbols: DataFrame, per_file: int = 4, most: int = 25) -> DataFrame:
    """Lines to open for found symbols (``query, doc, score``): at most ``per_file`` in a file and ``most`` in all, documents last."""
    j = hits.join(symbols.select(F.col("id").alias("doc"), "file_path", "start_line"), "doc")
    w = Window.partitionBy("query", "file_path").orderBy(F.desc("score"), "start_line", "doc")
    j = j.withColumn("_f", F.row_number().over(w)).where(F.col("_f") <= per_file)
    doc = F.col("file_path").rlike(r"(?i)\.(md|mdx|rst|txt)$").cast("int")
    v = Window.partitionBy("query").orderBy(doc, F.desc("score"), "file_path", "start_line", "doc")
    return j.withColumn("rank", F.row_number().over(v) - 1).where(F.col("rank") < most).drop("_f")


def focus(items: DataFrame, text: Column, words: list[str], most: int, order: Column) -> DataFrame:
    """All items while there are at most ``most``; beyond, those with any focus word, cut on a total order."""
    if items.count() <= most or not words:
        return items.orderBy(order).limit(most)
    low = F.lower(text)
    hit = None
    for w in words:
        c = F.contains(low, F.lit(w.lower()))
        hit = c if hit is None else hit | c
    return items.where(hit).orderBy(order).limit(most)


def transcript_digest(events: DataFrame, last: int = 20) -> DataFrame:
    """Requests, touched files and commands of each session's last events (``session_id, seq, role, text, tool, path, command``)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    e = events.withColumn("_rn", F.row_number().over(w))
    recent = e.where(F.col("_rn") <= last)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("seq", F.col(c).alias("v"))))), lambda x: x["v"])
    asked = recent.where("role = 'user'").groupBy("session_id").agg(ordered("text").alias("requests"))
    done = recent.where("role <> 'user'").groupBy("session_id").agg(F.array_distinct(ordered("path")).alias("files"), ordered("command").alias("commands"))
    return asked.join(done, "session_id", "full_outer")


def fresh(pages: DataFrame, now: float, ttl_hours: float = 24.0, fetched: str = "fetched_at") -> DataFrame:
    """Pages fetched within the time to live."""
    return pages.where(F.col(fetched) > now - ttl_hours * 3600.0)


def interleave(hits: DataFrame, scope: str = "scope", order: str = "rank") -> DataFrame:
    """Hits of several scopes in turn: the first of each, then the second of each."""
    w = Window.partitionBy(scope).orderBy(order)
    return hits.withColumn("round", F.row_number().over(w)).orderBy("round", scope)
