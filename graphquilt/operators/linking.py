"""Edges derived from references by name: imports to files, calls to functions, bases to classes.

Each rule proposes candidates with a priority; the least priority of a site
wins.  Candidates come from equi-joins on names or paths, so the order in which
files arrive cannot matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import is_test

#: On a receiver of unknown type a method name links only when so few functions carry it.
MOST_TARGETS = 3
#: Levels of base classes a call on a class climbs.
MOST_LEVELS = 8
# Methods that every code calls on objects of other libraries.
COMMON_METHODS = tuple(
    "get items keys values update pop setdefault copy clear append extend insert remove index count sort reverse add discard union join split strip lstrip rstrip replace format encode decode startswith endswith lower upper title find read write close open readline readlines flush seek exists mkdir unlink read_text write_text glob resolve stat touch execute executemany commit rollback fetchone fetchall cursor scalar scalars first one all refresh merge delete begin connect query filter where order_by limit offset post put patch request send json wait cancel result done start stop run text debug info warning warn error exception critical log push shift slice splice map reduce forEach findIndex includes indexOf some every concat entries then catch finally toString trim toLowerCase toUpperCase startsWith endsWith has set emit on off once".split()
)


def family(path: Column | str) -> Column:
    """Functions of one family may call each other: Python, the script languages, else the suffix."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(".py", ".pyw", ".pyi"), "py").when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte"), "js").otherwise(ext)


def call_edges(sites: DataFrame, functions: DataFrame, imports: DataFrame, has_method: DataFrame | None = None, inherits: DataFrame | None = None) -> DataFrame:
    """Call edges of sites: ``from_id, to_id, rule`` (0 same class or bases, 1 same file, 2 imported file, 3 few of that name).

    Code of one language family only; product code never links into tests; a bare
    or attribute call that no import explains links only to a name carried by at
    most ``MOST_TARGETS`` functions, and never to a common method.

    Every rule is an equi-join of its own on all that it asks for, and names are
    counted before they are joined, so a name that thousands of functions carry is
    never paired with all sites that use it.
    """
    f = functions.select(F.col("id").alias("to_id"), "name", F.col("file_path").alias("to_file")).distinct().withColumn("fam", family("to_file")).withColumn("to_test", is_test("to_file"))
    s = sites.drop("to_id").withColumn("fam", family("file_path")).withColumn("from_test", is_test("file_path"))
    keep = ["from_id", "name", "kind", "hint", "to_id", "rule"]

    def linked(j: DataFrame, rule: int) -> DataFrame:
        return j.where("(from_test or not to_test) and from_id <> to_id").withColumn("rule", F.lit(rule)).select(keep)

    of_class = f.withColumn("ctx", F.regexp_extract(F.substring_index("to_id", "::", -1), r"^(.*)\.[^.]+$", 1)).withColumnRenamed("to_file", "file_path")
    own_class = linked(s.where("kind = 'self'").join(of_class, ["name", "fam", "file_path", "ctx"]), 0)
    own_file = linked(s.where("kind <> 'self'").join(f.withColumnRenamed("to_file", "file_path"), ["name", "fam", "file_path"]), 1)
    imp = imports.select(F.col("from_path").alias("file_path"), F.col("to_path").alias("to_file")).where("to_file is not null and to_file <> ''").distinct()
    # the functions an importing file can see: a row per import and function of the imported file
    seen = imp.join(f, "to_file")
    imported = linked(s.join(seen, ["file_path", "name", "fam"]), 2)
    few = f.groupBy("name", "fam").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= MOST_TARGETS) & ~F.col("name").isin(*COMMON_METHODS)).select("name", "fam")
    loose = linked(s.where(F.col("kind").isin("attr", "")).join(f.join(few, ["name", "fam"]), ["name", "fam"]), 3)
    c = own_class.unionByName(own_file).unionByName(imported).unionByName(loose)
    if has_method is not None and inherits is not None:
        c = c.unionByName(_inherited(s, functions, has_method, inherits))
    w = Window.partitionBy("from_id", "name", "kind", "hint")  # the candidates of one site
    return c.withColumn("_best", F.min("rule").over(w)).where("rule = _best").groupBy("from_id", "to_id").agg(F.min("rule").alias("rule"))


def ancestors(inherits: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """``class_id, base_id, level`` up to ``levels``, the nearest level of each base."""
    e = inherits.select(F.col("from_id").alias("class_id"), F.col("to_id").alias("base_id")).distinct()
    out, front = e.withColumn("level", F.lit(1)), e
    for k in range(2, levels + 1):
        front = front.join(e.select(F.col("class_id").alias("base_id"), F.col("base_id").alias("_b")), "base_id").select("class_id", F.col("_b").alias("base_id")).distinct()
        out = out.unionByName(front.withColumn("level", F.lit(k)))
    return out.groupBy("class_id", "base_id").agg(F.min("level").alias("level"))


def _inherited(sites: DataFrame, functions: DataFrame, has_method: DataFrame, inherits: DataFrame) -> DataFrame:
    """Calls on one's own class that a base class answers."""
    s = sites.where("kind = 'self' and ctx <> ''").withColumn("class_id", F.concat("file_path", F.lit("::"), "ctx"))
    up = ancestors(inherits)
    m = has_method.select(F.col("from_id").alias("base_id"), "to_id").join(functions.select(F.col("id").alias("to_id"), "name"), "to_id")
    j = s.join(up, "class_id").join(m, ["base_id", "name"])
    w = Window.partitionBy("from_id", "name")
    return j.withColumn("_l", F.min("level").over(w)).where("level = _l").select("from_id", "name", "kind", "hint", "to_id", F.lit(0).alias("rule"))


def inherit_edges(name_refs: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """Class to base class: in the same file, else in an imported one, else the only class of that name."""
    r = name_refs.where("kind = 'inherits'").select("from_id", "file_path", F.substring_index(F.regexp_replace("name", r"<.*", ""), ".", -1).alias("name"))
    c = classes.select(F.col("id").alias("to_id"), "name", F.col("file_path").alias("to_file"))
    n = c.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    imp = imports.select(F.col("from_path").alias("file_path"), F.col("to_path").alias("to_file")).distinct().withColumn("imported", F.lit(True))
    j = r.join(c, "name").join(n, "name").join(imp, ["file_path", "to_file"], "left").where("from_id <> to_id")
    rule = F.when(F.col("file_path") == F.col("to_file"), 0).when(F.col("imported"), 1).when(F.col("n") == 1, 2)
    j = j.withColumn("rule", rule).where("rule is not null")
    w = Window.partitionBy("from_id", "name")
    return j.withColumn("_b", F.min("rule").over(w)).where("rule = _b").select("from_id", "to_id").distinct()


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (``path, name`` module, ``qualified`` symbol) resolved to files: ``from_path, to_path, symbol, kind``.

    Every module yields candidate paths by the rules of its language (relative
    steps, package folders, index files, suffixes); each is matched from the end of
    the path against the files, the longest shared prefix with the importer wins.
    """
    f = files.select(F.col("path").alias("to_path")).where("to_path is not null").distinct()
    fam = family("path")
    here = F.regexp_replace("path", r"/?[^/]*$", "")
    mod = F.col("name")
    py_rel = F.regexp_extract("name", r"^(\.+)", 1)
    up = F.regexp_replace(here, F.concat(F.lit(r"(/[^/]+){"), F.greatest(F.length(py_rel) - 1, F.lit(0)).cast("string"), F.lit("}$")), "")
    tail = F.regexp_replace(F.regexp_replace("name", r"^\.+", ""), r"\.", "/")
    py_base = F.when(py_rel != "", F.concat_ws("/", up, F.when(tail != "", tail))).otherwise(tail)
    py = F.array(F.concat(py_base, F.lit(".py")), F.concat(py_base, F.lit("/__init__.py")), F.concat(py_base, F.lit("/"), "qualified", F.lit(".py")))
    # steps up and down a folder, folded over the segments
    walked = F.aggregate(
        F.split(F.concat_ws("/", here, mod), "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    js_root = F.when(mod.startswith("."), F.array_join(walked, "/")).otherwise(F.regexp_replace(mod, r"^(@/|~/|#)", ""))
    endings = F.array(*[F.lit(x) for x in ("", ".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.vue")])
    js = F.transform(endings, lambda x: F.concat(js_root, x))
    java = F.array(F.concat(F.regexp_replace("name", r"\.", "/"), F.lit(".java")))
    rust = F.array(*[F.concat(F.regexp_replace(F.regexp_replace("name", r"^(crate|self|super)::", ""), "::", "/"), F.lit(x)) for x in (".rs", "/mod.rs")])
    cand = F.when(fam == "py", py).when(fam == "js", js).when(fam == ".java", java).when(fam == ".rs", rust).otherwise(F.array())
    i = imports.select("path", "name", F.coalesce("qualified", F.lit("")).alias("qualified"), F.posexplode(cand).alias("pri", "cand")).where("cand is not null and cand <> ''")
    # a file is found under every tail of its path, a handful, so a candidate meets only files that end with all of it
    parts = F.split("to_path", "/")
    g = f.withColumn("cand", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))))
    j = i.join(g, "cand")
    # how many leading folders importer and target share
    a, b = F.split("path", "/"), F.split("to_path", "/")
    n = F.least(F.size(a), F.size(b))
    shared = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0).alias("c"), F.lit(True).alias("on")), lambda acc, x: F.struct(F.when(acc["on"] & (F.element_at(a, x) == F.element_at(b, x)), acc["c"] + 1).otherwise(acc["c"]).alias("c"), (acc["on"] & (F.element_at(a, x) == F.element_at(b, x))).alias("on")), lambda acc: acc["c"])
    best = j.where("path <> to_path").groupBy("path", "name", "qualified").agg(F.min_by("to_path", F.struct(F.col("pri"), -shared, F.col("to_path"))).alias("to_path"))
    return best.select(F.col("path").alias("from_path"), "to_path", F.col("qualified").alias("symbol"), F.lit("").alias("kind")).dropDuplicates(["from_path", "to_path", "symbol"])


def conformers(methods: DataFrame) -> DataFrame:
    """Structural conformance: ``interface_id, class_id`` where every method name of the interface is defined by the class.

    ``methods`` has ``class_id, name, is_interface``.  Candidates share the
    interface's rarest method name.
    """
    m = methods.distinct()
    need = m.where("is_interface").groupBy("class_id").agg(F.count(F.lit(1)).alias("need"))
    have = m.where("not is_interface").select(F.col("class_id").alias("c"), "name")
    df = have.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    rare = m.where("is_interface").join(df, "name").groupBy("class_id").agg(F.min(F.struct("df", "name")).alias("r")).select("class_id", F.col("r.name").alias("name"))
    cand = rare.join(have, "name").select("class_id", "c")
    hit = cand.join(m.where("is_interface").select("class_id", "name"), "class_id").join(have, ["c", "name"]).groupBy("class_id", "c").agg(F.count(F.lit(1)).alias("k"))
    return hit.join(need, "class_id").where("k = need").select(F.col("class_id").alias("interface_id"), F.col("c").alias("class_id"))
