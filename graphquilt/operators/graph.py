"""Graph walks and structure, a hop per join.

Frontiers are DataFrames.  A walk joins the frontier with the edges, drops what
was seen by an anti join and cuts its lineage with a reliable checkpoint every
few hops; nothing but one count per hop comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, materialise
from .skew import hot_keys, salted_join, salted_semi_join

# Names that something outside the code calls.
ENTRY_NAMES = ("__init__", "__main__", "main", "app", "setup", "teardown", "conftest", "pytest_configure", "pytest_collection_modifyitems", "lifespan", "startup", "shutdown")
HUB_LEAST_DEGREE = 10
HUB_PERCENTILE = 0.99


def pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges as (src, dst), nulls and empty ends dropped."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> '' and dst <> ''").distinct()


def live(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges both ends of which exist; a target that many edges share is spread (sources are left to adaptive execution, they share less)."""
    k = nodes.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    e = edges.join(k, F.col("src") == F.col("_k"), "left_semi")
    return salted_semi_join(e, k.withColumnRenamed("_k", "dst"), "dst", F.col("src"), hot=hot_keys(edges, "dst")).select(*edges.columns)


def with_ends(edges: DataFrame, nodes: DataFrame, key: str, value: str, src: str, dst: str) -> DataFrame:
    """``edges`` with a value of either end's node as columns ``src`` and ``dst``, edges without both nodes dropped; shared targets are spread."""
    n = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    e = salted_join(edges, n.select(F.col(key).alias("dst"), F.col(value).alias("_d")), "dst", F.col("src"))
    e = e.join(n.select(F.col(key).alias("src"), F.col(value).alias("_s")), "src")
    return e.select(*edges.columns, F.col("_s").alias(src), F.col("_d").alias(dst))


def hop(front: DataFrame, edges: DataFrame, at: str, hot: DataFrame) -> DataFrame:
    """Edges (``src``, ...) that leave the rows of ``front`` at its column ``at``; the hot ends of the edges, found once for a walk, are spread."""
    return salted_join(edges, front.withColumnRenamed(at, "src"), "src", F.col("dst"), hot=hot)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Nodes reached from each start within ``max_depth`` hops: ``start, node, depth`` (least depth).

    A start is in its own result only when it lies on a cycle short enough.
    """
    edges = cut(edges)
    hot = cut(hot_keys(edges, "src"))
    first = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("node", F.col("start"))
    front = hop(first, edges, "node", hot).select("start", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1))
    seen = front
    for depth in range(2, max_depth + 1):
        step = hop(front.select("start", "node"), edges, "node", hot).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def distances(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """Least hops from any start: ``node, depth, origin`` (origin: the least start among the nearest); starts have 0."""
    seen = starts.select(F.col(starts.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)).withColumn("origin", F.col("node"))
    edges = cut(edges)
    front, hot = seen, cut(hot_keys(edges, "src"))
    for depth in range(1, max_depth + 1):
        step = hop(front.select("node", "origin"), edges, "node", hot).groupBy(F.col("dst").alias("node")).agg(F.min("origin").alias("origin"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "origin"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def path_between(edges: DataFrame, src: str, dst: str, max_depth: int = 12) -> DataFrame:
    """The shortest path as one row (``path`` array, ``hops``), least nodes on ties; no row when there is none."""
    spark = edges.sparkSession
    front = spark.createDataFrame([(src, [src])], "node string, path array<string>")
    edges = cut(edges)
    seen, hot = front.select("node"), cut(hot_keys(edges, "src"))
    for hops in range(max_depth + 1):
        hit = front.where(F.col("node") == dst)
        if not hit.isEmpty():
            return hit.select("path", F.lit(hops).alias("hops"))
        step = hop(front, edges, "node", hot).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("path")).alias("path"))
        front = cut(step.join(seen, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
    return front.where("false").select("path", F.lit(0).alias("hops"))


def _rank(kind: Column) -> Column:
    return F.when(kind == "reexport", 0).when(kind == "dynamic", 2).otherwise(1)


def importers(imports: DataFrame, local_imports: DataFrame | None = None) -> DataFrame:
    """Importer and imported file with the strongest kind of link: ``src, dst, kind, local``.

    ``local_imports`` (src, dst) are imports inside function bodies; they count
    where no module-level import links the same files.
    """
    base = imports.where("from_path is not null and to_path is not null and from_path <> '' and to_path <> ''")
    k = F.coalesce("kind", F.lit(""))
    out = base.groupBy(F.col("from_path").alias("src"), F.col("to_path").alias("dst")).agg(F.min(_rank(k)).alias("r")).select("src", "dst", F.element_at(F.array(F.lit("reexport"), F.lit(""), F.lit("dynamic")), F.col("r") + 1).alias("kind"), F.lit(False).alias("local"))
    if local_imports is not None:
        extra = local_imports.select("src", "dst").distinct().join(out.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit("").alias("kind"), F.lit(True).alias("local"))
        out = out.unionByName(extra)
    return out


def impact_of_files(links: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """Files that import the starts, directly or through others: ``start, file, depth, via``.

    ``links`` is the result of ``importers``.  A file that re-exports passes its
    importers on within the same hop; an importer inside a function body is in
    but not walked on from.  Nothing is capped.
    """
    s = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    front = s.select("start", F.col("start").alias("file"))
    seen = front.withColumn("depth", F.lit(0)).withColumn("via", F.lit("")).withColumn("stop", F.lit(False))
    e = cut(links.select(F.col("dst").alias("file"), F.col("src").alias("by"), "kind", "local"))
    hot = cut(hot_keys(e, "file"))
    for depth in range(1, max_depth + 1):
        now, nxt = front, None
        while True:
            step = salted_join(e, now.select("start", "file"), "file", F.col("by"), hot=hot).groupBy("start", F.col("by").alias("file")).agg(F.min(_rank(F.col("kind"))).alias("r"), F.min(F.col("local")).alias("stop"))
            step = step.join(seen.select("start", "file"), ["start", "file"], "left_anti")
            step = cut(step.select("start", "file", F.lit(depth).alias("depth"), F.element_at(F.array(F.lit("reexport"), F.lit("import"), F.lit("dynamic")), F.col("r") + 1).alias("via"), "stop"))
            if step.isEmpty():
                break
            seen = seen.unionByName(step)
            nxt = step if nxt is None else nxt.unionByName(step)
            now = step.where("via = 'reexport'").select("start", "file")
        if nxt is None:
            break
        front = nxt.where("not stop and via <> 'reexport'").select("start", "file")
    return seen.where("depth > 0").select("start", "file", "depth", "via")


def callers_of_files(calls: DataFrame, functions: DataFrame, files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Files with a function that calls into the files: ``start, file, depth`` (least)."""
    f = functions.select("id", "file_path")
    starts = f.join(files.select(F.col(files.columns[0]).alias("file_path")).distinct(), "file_path").select("id", F.col("file_path").alias("start"))
    e = live(pairs(calls, "from_id", "to_id"), functions, "id")
    seen = starts.select("start", F.col("id").alias("node")).withColumn("depth", F.lit(0))
    front, back = seen.select("start", "node"), cut(reverse(e))
    hot = cut(hot_keys(back, "src"))
    for depth in range(1, max_depth + 1):
        step = hop(front, back, "node", hot).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    hit = seen.where("depth > 0").join(f, F.col("node") == F.col("id")).where("file_path is not null and file_path <> start")
    return hit.groupBy("start", F.col("file_path").alias("file")).agg(F.min("depth").alias("depth"))


def dead_code(functions: DataFrame, calls: DataFrame, include_private: bool = False, file_path: str = "") -> DataFrame:
    """Functions nothing calls, without entry points and (by default) private ones."""
    ends = calls.select(F.col("to_id").alias("id")).where("id is not null").distinct()
    f = functions.where(~F.coalesce(F.col("name"), F.lit("")).isin(*ENTRY_NAMES))
    if not include_private:
        f = f.where(~F.coalesce(F.col("name"), F.lit("")).startswith("_"))
    if file_path:
        f = f.where(F.col("file_path") == file_path)
    return f.join(ends, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node, direction aside, self links dropped."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return both.select(F.col("a").alias("node")).unionAll(both.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hubs(degree: DataFrame, least: int = HUB_LEAST_DEGREE, percentile: float = HUB_PERCENTILE) -> DataFrame:
    """Nodes whose degree reaches the value at index int(percentile * n) of the sorted degrees, and ``least``.

    The index is looked up on the histogram of degrees, which the largest degree bounds.
    """
    hist = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    # one window over distinct degrees, not nodes
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rank = F.least(F.col("total") - 1, F.floor(F.lit(percentile) * F.col("total")))
    at = run.where(F.col("upto") > rank).agg(F.min("degree"))
    return degree.where(F.col("degree") >= F.greatest(F.lit(least), at.scalar()))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Weakly connected components: ``node, component`` (its least node).

    Alternating large-star and small-star steps: each round links nodes to the
    least node of their neighbourhood until nothing changes, a logarithmic number
    of rounds, all groupings pre-aggregated.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    last = None
    while True:
        # large star: every node's larger neighbours point at the least of its neighbourhood
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself point at the least
        m = big.groupBy("u").agg(F.min("v").alias("m"))
        j = big.join(m, "u")
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(m.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None and tuple(now) == tuple(last):
            break
        last = now
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    ends = e.select(F.col("v").alias("node")).distinct().join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    out = roots.unionByName(ends)
    if nodes is not None:
        out = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, or with a self link: ``node, component``.

    Trims nodes without both directions, then colours forward (each node takes
    the least node that reaches it) and collects backward inside each colour; a
    colour's root with all that it reaches backward is one component.  Repeats on
    the rest until no edge is left; every round removes at least one component.
    """
    self_loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        # trim: a node without an incoming or outgoing edge is alone
        n = e.count()
        while True:
            has_in, has_out = e.select(F.col("dst").alias("k")).distinct(), e.select(F.col("src").alias("k")).distinct()
            both = has_in.join(has_out, "k")
            e = cut(e.join(both, F.col("src") == F.col("k"), "left_semi").join(both, F.col("dst") == F.col("k"), "left_semi"))
            before, n = n, e.count()
            if n == before:
                break
        if n == 0:
            break
        colour = cut(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            step = e.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            new = cut(colour.join(step, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            changed = not new.where("moved").isEmpty()
            colour = new.select("node", "colour")
            if not changed:
                break
        # backward from each root within its colour
        same = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        same = cut(same)
        comp = cut(colour.where("node = colour"))
        front = comp
        while True:
            front = cut(front.join(same.drop("colour"), F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "colour").distinct().join(comp.select("node"), "node", "left_anti"))
            if front.isEmpty():
                break
            comp = comp.unionByName(front)
        comp = cut(comp)
        found = comp if found is None else found.unionByName(comp)
        e = cut(e.join(comp.select(F.col("node").alias("k")), F.col("src") == F.col("k"), "left_anti").join(comp.select(F.col("node").alias("k")), F.col("dst") == F.col("k"), "left_anti"))
    if found is None:
        return self_loops.select("node", F.col("node").alias("component"))
    size = found.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component"))
    big = found.join(size.where("n > 1"), "colour").select("node", "component")
    return big.unionByName(self_loops.join(big.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def cycles(edges: DataFrame) -> DataFrame:
    """One row per import cycle: ``component, n_files, members`` sorted.

    A cycle's members are the answer itself; their list is as long as the cycle.
    """
    return strong_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list("node")).alias("members"))


def file_graph(files: DataFrame, imports: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Undirected file links ``a, b, n_imports, n_calls, weight``: 1 for any import plus half the log2 of 1 + calls; tests left out."""
    keep = files.where(F.coalesce("role", F.lit("other")) != "test").select(F.col("path").alias("_k")).distinct()

    def kept(df: DataFrame) -> DataFrame:
        return df.where("x <> y").join(keep, F.col("x") == F.col("_k"), "left_semi").join(keep, F.col("y") == F.col("_k"), "left_semi")

    # edges are counted by their ends before anything is joined, so one pair of ends is one row
    i = kept(imports.groupBy(F.col("from_path").alias("x"), F.col("to_path").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("x is not null and y is not null"))
    c = calls.where("from_id is not null and to_id is not null").groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    c = kept(with_ends(c, functions, "id", "file_path", "x", "y").groupBy("x", "y").agg(F.sum("n").alias("n")))

    def paired(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias(name))

    g = paired(i, "n_imports").join(paired(c, "n_calls"), ["a", "b"], "full_outer").na.fill(0, ["n_imports", "n_calls"])
    return g.withColumn("weight", _weight())


def _weight() -> Column:
    w = F.when(F.col("n_imports") > 0, 1.0).otherwise(0.0) + F.when(F.col("n_calls") > 0, 0.5 * F.log2(F.col("n_calls") + 1)).otherwise(0.0)
    return F.round(w, 6)


def numbered(nodes: DataFrame) -> DataFrame:
    """``node, id`` with a number of its own for each node: a hash, of another seed where two nodes share one."""
    seed = 0
    while True:
        names = cut(nodes.select("node", F.xxhash64("node", F.lit(seed)).alias("id")))
        n, distinct = names.agg(F.count("id"), F.countDistinct("id")).first()
        if n == distinct:
            return names
        seed += 1


def _print(name: str) -> Column:
    """128 bits that stand for a name in joins: two of a billion names share them with a chance under 1e-20."""
    return F.struct(F.xxhash64(name).alias("h"), F.xxhash64(F.lit(1), name).alias("g"))


def numbered_links(files: DataFrame, imports: DataFrame, functions: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, id`` of the files and the links of ``file_graph`` between their numbers, ``a, b, weight``.

    Names are joined by their prints and links by numbers, so the paths of a link's ends are not shuffled.
    """
    names = numbered(files.where(F.coalesce("role", F.lit("other")) != "test").select(F.col("path").alias("node")).where("node is not null").distinct())
    at = lambda k, v: names.select(_print("node").alias(k), F.col("id").alias(v))
    f = functions.where("id is not null").groupBy(_print("id").alias("k")).agg(F.max("file_path").alias("path")).where("path is not null")
    f = materialise(f.select("k", _print("path").alias("p")).join(at("p", "file"), "p").select("k", "file"), "functions")
    of = lambda k, v: f.select(F.col("k").alias(k), F.col("file").alias(v))
    i = imports.where("from_path is not null and to_path is not null and from_path <> to_path").groupBy(_print("from_path").alias("src"), _print("to_path").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    i = i.join(at("dst", "y"), "dst").select("src", "y", "n").join(at("src", "x"), "src")
    c = calls.where("from_id is not null and to_id is not null").select(_print("from_id").alias("src"), _print("to_id").alias("dst"))
    c = salted_join(c, of("dst", "y"), "dst", F.col("src")).select("src", "y").join(of("src", "x"), "src").where("x <> y")
    pair = lambda df, n_imports, n_calls: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), n_imports.cast("long").alias("n_imports"), n_calls.cast("long").alias("n_calls"))
    g = pair(i, F.col("n"), F.lit(0)).unionAll(pair(c, F.lit(0), F.lit(1))).groupBy("a", "b").agg(F.sum("n_imports").alias("n_imports"), F.sum("n_calls").alias("n_calls"))
    return names, g.select("a", "b", _weight().alias("weight"))


def modularity(links: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Newman modularity of a partition (``node, community``) of weighted undirected links ``a, b, weight``, one row."""
    ma = membership.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    mb = membership.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = links.where("weight > 0").join(ma, "a").join(mb, "b")
    deg = e.select(F.col("ca").alias("c"), "weight").unionAll(e.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("tot"))
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg((F.sum("weight") * 2).alias("inside"))
    m2 = deg.agg(F.sum("tot").alias("m2"))
    q = deg.join(inside, "c", "left").withColumn("m2", m2.scalar())
    return q.agg(F.round(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m2") - F.lit(resolution) * F.pow(F.col("tot") / F.col("m2"), 2)), F.lit(0.0)), 4).alias("modularity"))
