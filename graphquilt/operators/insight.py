"""Overviews: usage, churn, ownership, layers, tests, summaries, types and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .graph import importers, live, pairs, with_ends


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding of a double by way of a decimal, so that ties do not hang on its last bit."""
    return F.round(x.cast("decimal(28,9)"), places).cast("double")


def calls(log: DataFrame, *columns: str) -> DataFrame:
    """The given columns of every call; a row delivered twice, unchanged, is one call."""
    return log.select("id", *columns).distinct()



def call_stats(log: DataFrame) -> DataFrame:
    """Calls, errors (success 0), latency and size per tool, busiest first in the order of the caller; a latency that is NaN is none."""
    ms = F.when(~F.isnan("latency_ms"), F.col("latency_ms"))
    return calls(log, "tool", "success", "latency_ms", "result_size").groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("success") == 0, 1)).alias("errors"),
        rounded(F.avg(ms), 2).alias("avg_ms"),
        rounded(F.min(ms), 2).alias("min_ms"),
        rounded(F.max(ms), 2).alias("max_ms"),
        F.sum(F.col("result_size").cast("decimal(38,0)")).alias("bytes"),
    )


def calls_by_origin(log: DataFrame) -> DataFrame:
    return calls(log, "tool", "origin").groupBy("tool", F.coalesce("origin", F.lit("unknown")).alias("origin")).agg(F.count(F.lit(1)).alias("calls"))


def error_rate(log: DataFrame) -> DataFrame:
    """All calls, errors and the rate as text, one row."""
    bad = F.count(F.when(F.col("success") == 0, 1))
    n = F.count(F.lit(1))
    return calls(log, "success").agg(n.alias("calls"), bad.alias("errors"), F.format_string("%.1f%%", F.coalesce(100.0 * bad / n, F.lit(0.0))).alias("rate"))


def call_history(log: DataFrame) -> DataFrame:
    """Calls and errors per day."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    return calls(log, "timestamp", "success").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("success") == 0, 1)).alias("errors"))


def top_tools(log: DataFrame, k: int = 3) -> DataFrame:
    """The k busiest tools of each day; the window runs over tools, not calls."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    c = calls(log, "timestamp", "tool").groupBy(day.alias("day"), "tool").agg(F.count(F.lit(1)).alias("calls"))
    w = Window.partitionBy("day").orderBy(F.desc("calls"), F.col("tool").asc_nulls_last())
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def session_unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items (session_id, kind, key, ...) not shown in their session before."""
    return items.join(seen.select("session_id", "kind", "key").distinct(), ["session_id", "kind", "key"], "left_anti")


def churn(commits: DataFrame) -> DataFrame:
    """Per file: commits, last change, authors with counts, lines added and deleted (binary changes count no lines)."""
    per_author = commits.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"), F.max("author_time").alias("last"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    authors = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce("author", F.lit("")) != "", F.struct("author", "n")))))
    return per_author.groupBy("path").agg(F.sum("n").alias("commits"), F.coalesce(F.max("last"), F.lit(0)).alias("last_modified"), authors.alias("authors"), F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("lines_deleted"))


def ownership(commits: DataFrame) -> DataFrame:
    """Authors of each file, ranked by commits, then by last commit."""
    o = commits.where(F.coalesce("author", F.lit("")) != "").groupBy("path", "author").agg(F.count(F.lit(1)).alias("commits"), F.max("author_time").alias("last_commit"))
    w = Window.partitionBy("path").orderBy(F.desc("commits"), F.desc("last_commit"), "author")
    return o.withColumn("rank", F.row_number().over(w))


def in_degree(imports: DataFrame) -> DataFrame:
    """Import edges into each file, one per symbol."""
    return imports.where("to_path is not null and to_path <> ''").groupBy(F.col("to_path").alias("path")).agg(F.count(F.lit(1)).alias("importers"))


def hotspots(changes: DataFrame, degree: DataFrame, now: float) -> DataFrame:
    """Change risk: 45 points for commits and 35 for importers on a log scale of the maximum, 20 for recency.

    ``changes`` has ``path, commits, last_modified``.
    """
    j = changes.join(degree, "path", "left").na.fill(0, ["importers"])
    j = j.withColumn("_mc", changes.agg(F.log1p(F.max("commits"))).scalar()).withColumn("_mi", degree.agg(F.log1p(F.max("importers"))).scalar())
    commit = F.when(F.col("_mc") > 0, F.log1p("commits") / F.col("_mc")).otherwise(0.0)
    imp = F.when((F.col("_mi") > 0) & (F.col("importers") > 0), F.log1p("importers") / F.col("_mi")).otherwise(0.0)
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_modified")) / 86400.0)
    fresh = F.when(F.coalesce(F.col("last_modified"), F.lit(0)) > 0, 1.0 / (1.0 + age / 30.0)).otherwise(0.0)
    return j.withColumn("score", rounded(100.0 * (0.45 * commit + 0.35 * imp + 0.20 * fresh), 2)).drop("_mc", "_mi")


def architecture(files: DataFrame, per_role: int = 10) -> DataFrame:
    """Files per layer and role with the first paths of each; the sample is bounded per partition before it is merged."""
    f = files.select(F.coalesce("layer", F.lit("other")).alias("layer"), F.coalesce("role", F.lit("other")).alias("role"), "path")
    n = f.groupBy("layer", "role").agg(F.count(F.lit(1)).alias("n_files"))
    w = Window.partitionBy("layer", "role").orderBy("path")
    # the optimizer keeps only per_role rows of each task's groups ahead of the shuffle
    first = f.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_role)
    lists = first.groupBy("layer", "role").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return n.join(lists, ["layer", "role"])


def domain_map(files: DataFrame, keyword: str, per_role: int = 8) -> DataFrame:
    """The same for files whose path has the keyword, case-insensitive."""
    return architecture(files.where(F.contains(F.lower("path"), F.lit(keyword.lower()))), per_role)


def layer_matrix(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct import links from layer to layer."""
    lay = files.select("path", F.coalesce("layer", F.lit("other")).alias("layer"))
    e = pairs(imports, "from_path", "to_path")
    return with_ends(e, lay, "path", "layer", "src_layer", "dst_layer").groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("n_links"))


def calls_without_import(functions: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that call into files they do not import: ``src, dst, n_calls``."""
    e = with_ends(pairs(calls, "from_id", "to_id"), functions, "id", "file_path", "a", "b")
    c = e.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("n_calls"))
    return c.join(imports.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).distinct(), ["src", "dst"], "left_anti")


def layer_inversions(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Links from an inner layer to an outer one: domain to application or presentation, application to presentation."""
    m = layer_matrix(files, imports)
    s, d = F.col("src_layer"), F.col("dst_layer")
    return m.where(((s == "domain") & d.isin("application", "presentation")) | ((s == "application") & (d == "presentation")) | ((s == "infra") & (d == "presentation")))


def file_summary(files: DataFrame, functions: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Per file: functions, documented ones, imports in and out, calls in and out over existing functions."""
    f = functions.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_functions"), F.count(F.when(F.trim(F.coalesce("docstring", F.lit(""))) != "", 1)).alias("n_documented"))
    e = live(pairs(imports, "from_path", "to_path"), files, "path")
    out = e.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("n_imports"))
    inc = e.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n_importers"))
    c = with_ends(pairs(calls, "from_id", "to_id"), functions, "id", "file_path", "a", "b").where("a <> b")
    co = c.groupBy(F.col("a").alias("path")).agg(F.count(F.lit(1)).alias("n_calls_out"))
    ci = c.groupBy(F.col("b").alias("path")).agg(F.count(F.lit(1)).alias("n_calls_in"))
    r = files.select("path", "lang", "role", "layer")
    for x in (f, out, inc, co, ci):
        r = r.join(x, "path", "left")
    return r.na.fill(0, ["n_functions", "n_documented", "n_imports", "n_importers", "n_calls_out", "n_calls_in"])


def callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Every called function with its distinct callers and calling files."""
    e = with_ends(pairs(calls, "from_id", "to_id"), functions, "id", "file_path", "src_file", "dst_file")
    g = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_callers"), F.countDistinct("src_file").alias("n_files"))
    return g.join(functions.select("id", "name", "file_path"), "id")


def resolution(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """How sure each call edge is: ``resolved`` when only one function has the callee's name, ``name`` when the caller's file imports nothing of it but few do, ``ambiguous`` otherwise."""
    n = functions.groupBy("name").agg(F.count(F.lit(1)).alias("same_name"))
    d = functions.select("id", F.struct("name", "file_path").alias("_f"))
    e = with_ends(pairs(calls, "from_id", "to_id"), d, "id", "_f", "s", "d").select("src", "dst", F.col("s.file_path").alias("src_file"), F.col("d.file_path").alias("dst_file"), F.col("d.name").alias("name"))
    e = e.join(n, "name")
    lab = F.when((F.col("same_name") == 1) | (F.col("src_file") == F.col("dst_file")), "resolved").when(F.col("same_name") <= 3, "name").otherwise("ambiguous")
    return e.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "same_name", lab.alias("resolution"))


def tests_of(files: DataFrame, imports: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Test files of every file: those importing it or calling into it: ``path, test, how``."""
    tests = files.where("role = 'test'").select(F.col("path").alias("test"))
    imp = importers(imports).select(F.col("dst").alias("path"), F.col("src").alias("test")).join(tests, "test", "left_semi").withColumn("how", F.lit("import"))
    c = with_ends(pairs(calls, "from_id", "to_id"), functions, "id", "file_path", "test", "path").select("path", "test").distinct().join(tests, "test", "left_semi").where("path <> test").withColumn("how", F.lit("call"))
    return imp.select("path", "test", "how").unionByName(c).groupBy("path", "test").agg(F.max("how").alias("how"))


def untested(files: DataFrame, imports: DataFrame, role: str = "", layer: str = "") -> DataFrame:
    """Source files no test file imports; tests and documents aside."""
    tests = files.where("role = 'test'").select(F.col("path").alias("src"))
    covered = importers(imports).join(tests, "src", "left_semi").select(F.col("dst").alias("path")).distinct()
    f = files.where(~F.coalesce("role", F.lit("")).isin("test", "doc"))
    if role:
        f = f.where(F.col("role") == role)
    if layer:
        f = f.where(F.col("layer") == layer)
    return f.join(covered, "path", "left_anti").select("path", "role", "layer")


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols (``id, kind, file_path, start_line, end_line``) that changed line ranges (``file_path, lo, hi``) touch.

    A function that overlaps a range is changed, enclosing ones too; a class only
    when a line of its own, outside its nested symbols, is.  Ranges meet symbols of
    their file only.
    """
    hit = symbols.join(ranges, "file_path").where((F.col("start_line") <= F.col("hi")) & (F.coalesce("end_line", "start_line") >= F.col("lo")))
    fn = hit.where("kind = 'function'").select("id", "kind", "file_path").distinct()
    cls = hit.where("kind = 'class'").select(F.col("id").alias("cid"), "file_path", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"), "lo", "hi").distinct()
    nested = symbols.select("file_path", F.col("id").alias("nid"), F.col("start_line").alias("ns"), F.col("end_line").alias("ne"))
    # own lines: the touched part of the class minus the union of what is nested in it
    j = cls.join(nested, "file_path").where("nid <> cid and cs <= ns and ne <= ce and not (cs = ns and ce = ne)")
    spans = j.select("cid", "file_path", "lo", "hi", "cs", "ce", "ns", "ne").groupBy("cid", "file_path", "lo", "hi", "cs", "ce").agg(F.collect_set(F.struct("ns", "ne")).alias("sp"))
    lines = cls.join(spans, ["cid", "file_path", "lo", "hi", "cs", "ce"], "left")
    first, last = F.greatest("lo", "cs"), F.least("hi", "ce")
    own = F.aggregate(
        F.array_sort(F.coalesce("sp", F.array().cast("array<struct<ns:bigint,ne:bigint>>"))),
        F.struct(first.cast("long").alias("at"), F.lit(False).alias("gap")),
        lambda acc, x: F.struct(F.greatest(acc["at"], F.when(x["ns"] <= acc["at"], x["ne"] + 1).otherwise(acc["at"])).alias("at"), (acc["gap"] | ((x["ns"] > acc["at"]) & (acc["at"] <= last))).alias("gap")),
        lambda acc: acc["gap"] | (acc["at"] <= last),
    )
    cl = lines.where(own).select(F.col("cid").alias("id"), F.lit("class").alias("kind"), "file_path").distinct()
    return fn.unionByName(cl)


def shared_types(types: DataFrame, least: float = 0.5, most_per_scope: int = 20) -> DataFrame:
    """Types of one name in different scopes with alike fields: ``name, scope_a, file_a, scope_b, file_b, score``.

    At most ``most_per_scope`` definitions of a name in a scope take part, by path
    (the feature's own limit), so a common name stays small.
    """
    w = Window.partitionBy("scope", "name").orderBy("file_path", "start_line")
    norm = F.array_distinct(F.transform("fields", lambda x: F.lower(F.regexp_replace(x, "[_-]", ""))))
    t = types.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most_per_scope).select("scope", "name", "file_path", norm.alias("f")).where("size(f) > 0")
    a, b = (t.select("name", F.col("scope").alias(f"scope_{x}"), F.col("file_path").alias(f"file_{x}"), F.col("f").alias(f"f_{x}")) for x in "ab")
    return a.join(b, "name").where("scope_a < scope_b").withColumn("score", F.round(jaccard(F.col("f_a"), F.col("f_b")), 2)).where(F.col("score") >= least).drop("f_a", "f_b")


def pr_overlap(changes: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Pairs of pull requests that touch one another: ``a, b, strong, indirect, weak``.

    ``changes`` has ``pr, path, ranges`` (null: the whole file).  Strong: shared
    symbols; indirect: one calls a symbol the other changed; weak: shared files.
    """
    r = changes.where("ranges is not null").select("pr", F.col("path").alias("file_path"), F.explode("ranges").alias("r")).select("pr", "file_path", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    part = r.join(symbols, "file_path").where("start_line <= hi and end_line >= lo").select("pr", "id")
    whole = changes.where("ranges is null").select("pr", F.col("path").alias("file_path")).join(symbols, "file_path").select("pr", "id")
    s = part.unionByName(whole).distinct()

    def counted(x: DataFrame, y: DataFrame, on: str, name: str) -> DataFrame:
        j = x.select(F.col("pr").alias("p"), on).join(y.select(F.col("pr").alias("q"), on), on).where("p <> q")
        return j.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), on).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))

    strong = counted(s, s, "id", "strong")
    via = s.join(calls.select(F.col("from_id").alias("id"), "to_id").distinct(), "id").select("pr", F.col("to_id").alias("id")).distinct()
    indirect = counted(via, s, "id", "indirect")
    weak = counted(changes.select("pr", "path").distinct(), changes.select("pr", "path").distinct(), "path", "weak")
    return weak.join(strong, ["a", "b"], "full_outer").join(indirect, ["a", "b"], "full_outer").na.fill(0, ["strong", "indirect", "weak"]).select("a", "b", "strong", "indirect", "weak")


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table, one scan each, as ``table, n``."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n_files"))


def top_directories(files: DataFrame, share: float = 0.7, deepest: int = 3) -> DataFrame:
    """Files per directory at the first depth (1 to ``deepest``) at which the largest holds at most ``share`` of all.

    All depths come from one pass; directories shallower than the depth count as they are.
    """
    d = F.filter(F.split(F.regexp_replace("path", r"[^/]*$", ""), "/"), lambda x: x != "")
    x = files.select(d.alias("d"), F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"))
    c = x.groupBy("depth", F.concat_ws("/", F.slice("d", F.lit(1), F.col("depth"))).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"))
    worst = c.groupBy("depth").agg((F.max("n_files") / F.sum("n_files")).alias("worst"))
    pick = worst.agg(F.coalesce(F.min(F.when(F.col("worst") <= share, F.col("depth"))), F.lit(deepest)).alias("_d"))
    return c.where(F.col("depth") == pick.scalar())


def usefulness(files: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Files in the order a reader should open them: with definitions, no tests, by the bit length of their in-degree, newest first."""
    has = functions.select(F.col("file_path").alias("path")).distinct().withColumn("defines", F.lit(1))
    j = files.select("path", "role", "mtime").join(has, "path", "left").join(in_degree(imports), "path", "left").na.fill(0, ["defines", "importers"])
    bits = F.when(F.col("importers") > 0, F.length(F.bin("importers"))).otherwise(0)
    return j.select("path", "defines", (F.coalesce("role", F.lit("")) == "test").alias("is_test"), bits.alias("bits"), "mtime")


def fingerprint(files: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """A fingerprint of the index that any change of a file row or an edge count alters, independent of row order."""
    row = F.md5(F.concat_ws("|", F.coalesce("path", F.lit("")), F.coalesce("git_blob_sha", F.lit("")), F.coalesce(F.floor(F.col("mtime") * 1000).cast("long"), F.lit(0)).cast("string")))
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    f = files.agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("h"))
    parts = [F.col("n").cast("string"), F.col("h").cast("string")]
    for i, e in enumerate(edges):
        f = f.withColumn(f"e{i}", e.agg(F.count(F.lit(1))).scalar())
        parts.append(F.col(f"e{i}").cast("string"))
    return f.select(F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))
