"""HTTP endpoints: full paths through router mounts, and matching of concrete paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_MOUNTS = 8
BLOCK = 10_000
# A parameter of a path, and a segment that takes all that is left, as the routers of the frameworks write them.
PARAM = r"\{[^}/]*\}|<[^>/]*>|(?<![^/]):[A-Za-z_]\w*"
REST = r"^(?:\{[^}/:]*:path\}|<path:[^>/]*>|\*\w*|\[\.\.\.\w+\])$"


def joined(prefix: Column, path: Column) -> Column:
    """Two path parts with one slash between them."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", path).when(F.coalesce(path, F.lit("")) == "", prefix).otherwise(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def full_paths(endpoints: DataFrame, routers: DataFrame, includes: DataFrame) -> DataFrame:
    """Every full path of each endpoint: ``id, full_path``; none where a prefix is not a literal.

    ``routers`` has ``key, prefix, kind`` (app, router, blueprint; null prefix: not
    a literal), ``includes`` ``parent, child, prefix`` (null prefix with
    ``has_prefix``: not a literal).  Chains go up at most ``MOST_MOUNTS`` mounts and
    never through a router twice.
    """
    r = routers.select("key", "prefix", "kind")
    cur = r.where("prefix is not null").select("key", F.col("key").alias("top"), F.col("prefix").alias("mounted"), F.array("key").alias("seen"), F.col("kind").alias("top_kind"), F.lit(True).alias("own"))
    done = None
    inc = includes.select(F.col("child").alias("top"), "parent", F.col("prefix").alias("given"), "has_prefix")
    for _ in range(MOST_MOUNTS + 1):
        up = cur.join(inc, "top", "left").where("parent is null or not array_contains(seen, parent)")
        end = cur.where(F.col("top_kind") == "app").unionByName(cur.join(inc.select("top").distinct(), "top", "left_anti").where("top_kind <> 'app'").select(cur.columns))
        done = end if done is None else done.unionByName(end)
        nxt = up.where("parent is not null and top_kind <> 'app' and (not has_prefix or given is not null)").join(r.select(F.col("key").alias("parent"), F.col("prefix").alias("pp"), F.col("kind").alias("pk")), "parent").where("pp is not null")
        # a blueprint's own prefix is replaced by the one it is registered with
        mine = F.when((F.col("top_kind") == "blueprint") & F.col("own") & F.col("has_prefix"), F.col("given")).otherwise(joined(F.col("given"), F.col("mounted")))
        cur = nxt.select("key", F.col("parent").alias("top"), joined(F.col("pp"), mine).alias("mounted"), F.concat("seen", F.array("parent")).alias("seen"), F.col("pk").alias("top_kind"), F.lit(False).alias("own"))
    m = done.select("key", "mounted").distinct()
    e = endpoints.select("id", "path", F.concat("file_path", F.lit("::"), F.coalesce("router", F.lit(""))).alias("key"))
    p = joined(F.col("mounted"), F.col("path"))
    return e.join(m, "key").select("id", F.when(p == "", "/").otherwise(p).alias("full_path")).distinct()


def shape(path: Column) -> Column:
    """A path with every parameter as ``{}``."""
    return F.regexp_replace(path, PARAM, "{}")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _fit(stored: Column, want: Column) -> Column:
    """How well one segment takes another: 2 the same literal, 1 parameter for parameter or in part, 0 a bare parameter for a value, null not at all."""
    kind, asked = shape(stored), shape(want)
    pattern = F.concat(F.lit("^\\Q"), F.regexp_replace(stored, f"(?:{PARAM})+", r"\\E[^/]+\\Q"), F.lit("\\E$"))
    by_value = F.when(F.rlike(want, pattern), F.when(kind == "{}", 0).otherwise(1))
    return F.when(kind == stored, F.when(stored == want, 2)).when(asked != want, F.when(asked == kind, 1)).otherwise(by_value)


def _aligned(c: DataFrame) -> DataFrame:
    """Rows of ``s`` (stored segments) that take all of ``w``, with ``score``, ``n_same`` literals and ``rest``.

    What stands before a catch-all is laid against the front, what stands behind it
    against the end; the catch-all takes at least one segment.
    """
    c = c.withColumn("at", F.coalesce(F.array_position(F.transform("s", lambda x: x.rlike(REST)), F.lit(True)), F.lit(0)).cast("int"))
    n, m, at = F.size("s"), F.size("w"), F.col("at")
    c = c.where(F.when(at == 0, n == m).otherwise(m >= n))
    front = F.when(at == 0, n).otherwise(at - 1)
    back = F.when(at == 0, 0).otherwise(n - at)
    head = F.zip_with(F.slice("s", F.lit(1), front), F.slice("w", F.lit(1), front), _fit)
    tail = F.zip_with(F.slice("s", n - back + 1, back), F.slice("w", m - back + 1, back), _fit)
    c = c.withColumn("fits", F.concat(head, tail)).where(~F.exists("fits", lambda x: x.isNull()))
    return c.select("query", "id", "from", F.aggregate("fits", F.lit(0), lambda a, x: a + x).alias("score"), F.size(F.filter("fits", lambda x: x == 2)).alias("n_same"), (at > 0).alias("rest"))


def _glob(want: Column) -> Column:
    """A shell pattern as a regular expression: ``*`` and ``?`` cross slashes, classes as they are."""
    x = F.regexp_replace(want, r"[.+^$(){}|\\]", r"\\$0")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\*", ".*"), r"\?", "."), r"\[!", "[^"), F.lit("$"))


def find(endpoints: DataFrame, queries: DataFrame, path: str = "full_path", method: str = "method") -> DataFrame:
    """Endpoints that answer each query (``query, path, method``): ``query, id, how, rank``.

    ``exact`` takes the whole path and shares a literal segment with it (or is the
    same path but for parameter names), ``suffix`` a tail of the stored path, for
    queries without exact ones; a query with ``*``, ``?`` or ``[`` is a pattern over
    whole paths (``glob``).  Candidates share a literal at the same place from the
    end, or from the front where a catch-all follows.
    """
    e = endpoints.select("id", F.col(path).alias("stored"), F.upper(method).alias("m"), segments(F.col(path)).alias("s"))
    q = queries.select("query", F.col("path").alias("want"), F.upper(F.coalesce("method", F.lit(""))).alias("wm"), segments(F.col("path")).alias("w"))
    allowed = (F.col("wm") == "") | (F.col("m") == F.col("wm")) | (F.col("m") == "ANY")
    glob = F.col("want").rlike(r"[*?\[]")

    def places(df: DataFrame, of: str) -> DataFrame:
        n = F.size(of)
        both = lambda x, i: F.array(F.struct((n - i).alias("place"), x.alias("lit")), F.struct((-1 - i).alias("place"), x.alias("lit")))
        at = F.explode(F.flatten(F.transform(of, both)))
        return df.withColumn("k", at).select(*df.columns, "k.place", "k.lit").where((F.col("lit") == shape(F.col("lit"))) & ~F.col("lit").rlike(REST))

    literal = q.where(~glob)
    pairs = places(literal.select("query", "wm", "w"), "w").join(places(e.select("id", "m", "s"), "s"), ["place", "lit"]).where(allowed).select("query", "id").distinct()
    c = pairs.join(literal, "query").join(e, "id")
    tails = F.when(F.col("want").startswith("/") & ~F.exists("s", lambda x: x.rlike(REST)), F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)))).otherwise(F.array(F.lit(0)))
    c = c.withColumn("from", F.explode(tails)).withColumn("s", F.slice("s", F.col("from") + 1, F.size("s")))
    got = _aligned(c).where("n_same > 0").groupBy("query", "id").agg(F.max(F.when(F.col("from") == 0, F.struct("score", "rest"))).alias("whole"), F.max(F.when(F.col("from") > 0, F.col("score"))).alias("part"))
    hits = got.select("query", "id", F.when(F.col("whole").isNotNull(), "exact").otherwise("suffix").alias("how"), F.coalesce("whole.score", "part").alias("score"), F.coalesce("whole.rest", F.lit(False)).alias("rest"))
    # the same path but for the names of its parameters
    trimmed = lambda p: F.regexp_replace(shape(F.col(p)), "/+$", "")
    same = literal.withColumn("k", trimmed("want")).join(e.withColumn("k", trimmed("stored")), "k").where(allowed).select("query", "id", F.lit("exact").alias("how"), F.lit(0).alias("score"), F.lit(False).alias("rest"))
    # patterns could be anywhere: a stated set against all rows, in blocks of a fixed size
    wide = q.where(glob).select("query", "wm", _glob(F.col("want")).alias("rx"), _glob(trimmed("want")).alias("rx_shape"))
    blocks = -(-wide.count() // BLOCK)
    for b in range(blocks):
        part = F.broadcast(wide.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b))
        g = e.join(part, F.rlike(F.col("stored"), F.col("rx")) | F.rlike(trimmed("stored"), F.col("rx_shape"))).where(allowed)
        same = same.unionByName(g.select("query", "id", F.lit("glob").alias("how"), F.lit(0).alias("score"), F.lit(False).alias("rest")))
    h = hits.unionByName(same).groupBy("query", "id").agg(F.max_by(F.struct("how", "score", "rest"), F.struct((F.col("how") != "suffix").cast("int"), "score")).alias("b")).select("query", "id", "b.*").join(e.select("id", "stored").distinct(), "id")
    w = Window.partitionBy("query")
    h = h.withColumn("_exact", F.max((F.col("how") != "suffix").cast("int")).over(w)).where("_exact = 0 or how <> 'suffix'")
    return h.withColumn("rank", F.row_number().over(w.orderBy(F.col("rest").cast("int"), F.desc("score"), "stored", "id"))).select("query", "id", "how", "rank")
