"""Compositions: the architecture report, symbol lookup and the resume bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..session import materialise
from . import communities, graph, insight


#: Lookups too short for a trigram go against all names, in blocks of this size.
BLOCK = 10_000


def symbols(**tables: DataFrame) -> DataFrame:
    """``label, id, name, file_path`` over several kinds of nodes: each keyword is a label, each table has ``id, name, file_path``."""
    out = None
    for label, df in tables.items():
        x = df.select(F.lit(label).alias("label"), "id", "name", "file_path")
        out = x if out is None else out.unionByName(x)
    return out


def symbol_lookup(names: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Symbols for each query (``query, text``): exact names first, then prefixes, then names that contain it; ``query, id, match, rank`` and the label where there is one.

    A query of three letters and more meets the names that hold its rarest trigram;
    shorter ones are a stated set that goes against all names in blocks.
    """
    carried = [c for c in ("label",) if c in names.columns]
    asked = queries.select("query", F.lower("text").alias("_q")).where("length(_q) > 0").distinct()
    s = names.select("id", "name", *carried, F.lower("name").alias("_n")).where("_n is not null")
    grams = s.select(F.explode(trigrams("_n")).alias("g"), "id", "name", *carried, "_n")
    qg = asked.where("length(_q) >= 3").select("query", "_q", F.explode(trigrams("_q")).alias("g"))
    df = grams.join(qg.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rare = qg.join(df, "g", "left").groupBy("query", "_q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("query", "_q", F.col("r.g").alias("g"))
    j = rare.join(grams, "g").drop("g").where(F.contains(F.col("_n"), F.col("_q")))
    short = asked.where("length(_q) < 3")
    blocks = -(-short.count() // BLOCK)
    for b in range(blocks):
        part = F.broadcast(short.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b))
        j = j.unionByName(s.join(part, F.contains(F.col("_n"), F.col("_q"))).select(j.columns))
    match = F.when(F.col("_n") == F.col("_q"), 0).when(F.col("_n").startswith(F.col("_q")), 1).otherwise(2)
    w = Window.partitionBy("query").orderBy("match", F.length("name"), "name", "id", *carried)
    return j.distinct().withColumn("match", match).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit).select("query", *carried, "id", "match", "rank")


def impact_report(starts: DataFrame, files: DataFrame, imports: DataFrame, functions: DataFrame, calls: DataFrame, mentions: DataFrame | None = None, max_depth: int = 2) -> DataFrame:
    """What a change of files reaches, as rows ``start, section, key, n``.

    Sections: ``importer`` and ``caller`` (n: depth), ``test`` (tests among them),
    ``mention`` (documents, ``mentions`` has ``path, to_id``), and ``role`` and
    ``layer`` with the number of files that are reached in either way.
    """
    imp = graph.impact_of_files(graph.importers(imports), starts, max_depth).select("start", "file", "depth")
    cal = graph.callers_of_files(calls, functions, starts, max_depth)
    near = materialise(imp.withColumn("section", F.lit("importer")).unionByName(cal.withColumn("section", F.lit("caller"))), "impact")
    known = files.groupBy(F.col("path").alias("file")).agg(F.max(F.struct("role", "layer")).alias("r")).select("file", "r.role", "r.layer")
    reached = near.select("start", "file").distinct().join(known, "file")
    out = near.groupBy("start", "section", F.col("file").alias("key")).agg(F.min("depth").cast("long").alias("n"))
    tests = reached.where("role = 'test'").select("start", F.lit("test").alias("section"), F.col("file").alias("key"), F.lit(1).cast("long").alias("n"))
    out = out.unionByName(tests)
    for c in ("role", "layer"):
        out = out.unionByName(reached.groupBy("start", F.lit(c).alias("section"), F.coalesce(c, F.lit("other")).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    if mentions is not None:
        f = functions.select(F.col("id").alias("to_id"), F.col("file_path").alias("start")).join(starts.select(F.col(starts.columns[0]).alias("start")).distinct(), "start", "left_semi")
        out = out.unionByName(mentions.join(f, "to_id").groupBy("start", F.lit("mention").alias("section"), F.col("path").alias("key")).agg(F.countDistinct("to_id").alias("n")))
    return out


def architecture_report(files: DataFrame, imports: DataFrame, functions: DataFrame, calls: DataFrame, most: int = 10) -> DataFrame:
    """Findings as ``finding, subject, weight, rank``: pivots, bridges, sole links, layer inversions, calls without import and import cycles, the ``most`` heaviest of each."""
    # four findings read these two tables
    links = materialise(graph.file_graph(files, imports, functions, calls).select("a", "b", "weight"), "links")
    member = materialise(communities.detect(links), "members")
    e = materialise(graph.live(graph.pairs(imports, "from_path", "to_path"), files, "path"), "imports")
    w = Window.partitionBy("finding").orderBy(F.desc("weight"), "subject")

    def found(df: DataFrame, name: str, subject: Column, weight: Column) -> DataFrame:
        # one at a time, so the driver holds one plan and not all of them
        f = df.select(F.lit(name).alias("finding"), subject.alias("subject"), weight.cast("double").alias("weight"))
        return materialise(f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most), "finding")

    arrow = lambda a, b: F.concat(F.col(a), F.lit(" -> "), F.col(b))
    parts = [
        found(member.where("is_hub").join(graph.degrees(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "node"), "pivot", F.col("node"), F.col("degree")),
        found(communities.bridges(links, member).where("n_communities > 1"), "bridge", F.col("node"), F.col("n_communities")),
        found(communities.sole_links(links, member), "sole link", arrow("a", "b"), F.lit(1)),
        found(insight.layer_inversions(files, imports), "layer inversion", arrow("src_layer", "dst_layer"), F.col("n_links")),
        found(insight.calls_without_import(functions, calls, imports), "calls without import", arrow("src", "dst"), F.col("n_calls")),
        found(graph.cycles(e), "import cycle", F.array_join(F.slice("members", F.lit(1), F.lit(5)), ", "), F.col("n_files")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resume(parts: DataFrame, budget_bytes: int = 16_384) -> DataFrame:
    """What fits a budget, most important first: rows of ``session_id, priority, ts, text`` while their bytes add up to it; ``truncated`` tells whether something was left."""
    w = Window.partitionBy("session_id").orderBy("priority", F.desc("ts"), "text")
    p = parts.withColumn("_b", F.coalesce(F.octet_length("text"), F.lit(0)))
    p = p.withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_b").over(Window.partitionBy("session_id")))
    return p.where(F.col("_run") <= budget_bytes).withColumn("truncated", F.col("_all") > budget_bytes).drop("_b", "_run", "_all")


def record(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes with new ones appended; an id that is there already is replaced."""
    return notes.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def forget(notes: DataFrame, verdicts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and verdicts without the given ids; pointers to a forgotten note are cleared."""
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    kept = notes.join(gone, "id", "left_anti")
    if "superseded_by" in kept.columns:
        lost = gone.select(F.col("id").alias("superseded_by"), F.lit(True).alias("_lost"))
        kept = kept.join(lost, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("_lost"), None).otherwise(F.col("superseded_by"))).drop("_lost").select(*notes.columns)
    return kept, verdicts.join(gone.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def session_reset(mentions: DataFrame, session_id: str) -> DataFrame:
    """What sessions have seen, without one session."""
    return mentions.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))
